"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` words each). A passage is described by shares of byte
classes, word statistics and hashed byte trigrams, and encoded by a learned layer. Gated attention
(tanh times sigmoid; Ilse et al., 2018) weighs the passages, with weights learned from document
labels alone, and a logistic output scores the weighted sum of the encodings. So one bad passage
can decide about a long text, and no passage needs a label.

Fitting reads a bounded sample: ``FIT_ROWS`` labelled rows by hash of the id, ``FIT_PASSAGES`` evenly
spaced passages of each. Scoring reads every passage of every text.

Edge cases: a null or empty text is one passage of zeros; without labelled rows the score is 0.5, with
rows of one label only it is their smoothed share; labels with nulls aren't learned from; an id of null
is never held out nor learned from; repeated rows are returned as often as they occur; an empty table
gives no row. Only ids, text and the label are read, and held-out rows take no part in fitting.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import crc_mod, filter_texts, map_texts
from newsloom.llm.toxicity import training_rows

FIT_ROWS, FIT_PASSAGES = 6_000, 24
PASSAGE = 120
HASHED, HIDDEN, GATE = 32, 24, 12
CUT = 0.3
_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".", b",", b"!?", b"|",
    b"#$%&*@^~_=+<>\\/", b"'\"`-", b":;()[]{}",
]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _i
WIDTH = len(_CLASSES) + 1 + 7 + HASHED


def passage_features(words: list[bytes]) -> np.ndarray:
    """Shares of byte classes, word statistics and hashed trigrams of one passage."""
    out = np.zeros(WIDTH)
    if not words:
        return out
    n = len(words)
    data = np.frombuffer(b" ".join(words), np.uint8)
    classes = len(_CLASSES) + 1
    out[:classes] = np.bincount(_CLASS[data], minlength=classes) / len(data)
    sizes = np.fromiter(map(len, words), np.int64, n)
    out[classes: classes + 7] = (
        len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, min(sizes.mean(), 40) / 10,
        min(sizes.std(), 40) / 10, sum(w[-1:] in b".!?" for w in words) / n, sum(w[:1].isupper() for w in words) / n,
        min(n, PASSAGE) / PASSAGE,
    )
    if len(data) > 2:
        wide = data.astype(np.uint32)
        hashed = ((wide[:-2] * 0x9E3779B1 + wide[1:-1] * 0x85EBCA6B + wide[2:] * 0xC2B2AE35) >> np.uint32(16)) % HASHED
        counts = np.bincount(hashed, minlength=HASHED)
        out[classes + 7:] = counts / np.sqrt((counts**2).sum())
    return out


def bag(data: bytes, most: int | None = None) -> np.ndarray:
    """Passages of a whole text by rows; with ``most``, that many evenly spaced ones."""
    words = data.split()
    starts = list(range(0, len(words), PASSAGE)) or [0]
    if most is not None and len(starts) > most:
        starts = [starts[i * len(starts) // most] for i in range(most)]
    return np.stack([passage_features(words[a: a + PASSAGE]) for a in starts])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(x: np.ndarray, first: np.ndarray, w: dict):
    """Encodings, gates, attention by passage, bag sums and logits."""
    code = np.tanh(x @ w["enc"] + w["enc0"])
    left, right = np.tanh(code @ w["v"]), _sigmoid(code @ w["u"])
    raw = (left * right) @ w["a"]
    size = np.diff(np.append(first, len(x)))
    raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), size))
    attention = raw / np.repeat(np.add.reduceat(raw, first), size)
    pooled = np.add.reduceat(attention[:, None] * code, first, axis=0)
    return code, left, right, attention, size, pooled, pooled @ w["out"] + w["out0"]


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, *, steps: int = 250, rate: float = 0.02, l2: float = 1e-4, seed: int = 7) -> dict:
    """Adam on the mean cross-entropy of bags; ``first`` is each bag's first row of ``x``."""
    rng = np.random.default_rng(seed)
    w = {
        "enc": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "enc0": np.zeros(HIDDEN),
        "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "a": rng.normal(0, GATE**-0.5, GATE), "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "out0": np.zeros(1),
    }
    m, s = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        code, left, right, attention, size, pooled, logit = _forward(x, first, w)
        gap = (_sigmoid(logit) - y) / len(y)
        d_pooled = np.repeat(gap[:, None] * w["out"], size, axis=0)
        d_code = attention[:, None] * d_pooled
        d_att = (d_pooled * code).sum(1)
        d_raw = attention * (d_att - np.repeat(np.add.reduceat(attention * d_att, first), size))
        d_left = d_raw[:, None] * w["a"] * right * (1 - left**2)
        d_right = d_raw[:, None] * w["a"] * left * right * (1 - right)
        d_code += d_left @ w["v"].T + d_right @ w["u"].T
        d_in = d_code * (1 - code**2)
        grads = {
            "enc": x.T @ d_in, "enc0": d_in.sum(0), "v": code.T @ d_left, "u": code.T @ d_right, "a": (left * right).T @ d_raw,
            "out": pooled.T @ gap, "out0": np.array([gap.sum()]),
        }
        for k, p in w.items():
            grad = grads[k] + (l2 * p if p.ndim > 1 or k == "out" else 0)
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.99 * s[k] + 0.01 * grad**2
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, fold: int = 5, held_out: int = 0) -> dict:
    """Scaling and weights, from a bounded sample of labelled rows."""
    sample = training_rows(docs, labels, "quality", fold, held_out, rows)

    def bags(ys, texts):
        return [(y, bag(t, FIT_PASSAGES).astype(np.float32).ravel().tolist()) for y, t in zip(ys, texts)]

    # At most rows * FIT_PASSAGES * WIDTH numbers.
    found = sorted((int(r[0] > 0), r[1]) for r in map_texts(sample, "y int, x array<float>", bags, id_col="y", binary=True).collect())
    y = np.array([v for v, _ in found], float)
    if not len(y) or y.min() == y.max():
        return {"share": float((y.sum() + 0.5) / (len(y) + 1))}
    parts = [np.array(x, float).reshape(-1, WIDTH) for _, x in found]
    x = np.concatenate(parts)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    first = np.cumsum([0] + [len(p) for p in parts[:-1]])
    return {"mean": mean, "spread": spread, "w": train((x - mean) / spread, first, y)}


def scores_of(model: dict, texts: list[bytes]) -> tuple[list[float], list[list[float]]]:
    """Score of each text, and the attention of each of its passages."""
    if not texts:
        return [], []
    if "share" in model:
        counts = [max(1, -(-len(t.split()) // PASSAGE)) for t in texts]
        return [model["share"]] * len(texts), [[1.0 / n] * n for n in counts]
    parts = [bag(t) for t in texts]
    first = np.cumsum([0] + [len(p) for p in parts[:-1]])
    *_, attention, _, _, logit = _forward((np.concatenate(parts) - model["mean"]) / model["spread"], first, model["w"])
    return _sigmoid(logit).tolist(), [a.tolist() for a in np.split(attention, first[1:])]


def score(docs: DataFrame, model: dict, *, fold: int = 5, held_out: int = 0, cut: float = CUT) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, attention); attention is the weight of each passage."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def rows(ids, texts):
        for at in range(0, len(ids), 512):
            yield from zip(ids[at: at + 512], *scores_of(share.value, texts[at: at + 512]))

    scored = map_texts(docs, "doc_id long, score double, attention array<float>", rows, binary=True)
    return scored.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), fold) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"), "attention",
    )


def quality(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> DataFrame:
    """Fit on the labelled sample and score every row of ``docs``."""
    return score(docs, fit(docs, labels, rows=rows))


def keep_good(docs: DataFrame, model: dict, *, cut: float = CUT) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``cut``, all columns."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, lambda texts: [s >= cut for s in scores_of(share.value, texts)[0]])
