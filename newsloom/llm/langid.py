"""Language of texts by a linear-chain conditional random field over their words.

Every word (run of letters; a single letter of a script without blanks) has affix features (first and last one to three characters), inner
bigrams and trigrams, and lexicon features (log share of each language among the word's uses in
the sample; zero if unknown). Their weights give a word one emission score per language, the
same wherever it stands, so it is computed once per distinct word. Learned transitions tie
neighbouring words; forward-backward gives each word's posterior, so code-switched text is
labelled word by word. The language of a text is the one with the largest mean posterior.

Texts are cut into segments of ``SEGMENT`` words for the matrix work only: the product of a
segment's transfer matrices carries the forward and backward messages from one segment to the
next, so posteriors are exactly those of the whole text and a long text costs no long loop.

Fitting reads a bounded sample (``FIT_ROWS`` documents, ``FIT_WORDS`` consecutive words of each at a
place chosen by hash, the first 64 letters of each) and joins runs of different documents, so that switches are seen.

Edge cases: null texts and texts without a letter are ``und`` with score 0; a table without
learnable rows gives ``und`` everywhere; ties go to the smaller language name; an id of null is
never held out nor learned from; repeated rows are returned as often as they occur; an empty table
gives no row. Only id and text are read for a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import crc_mod, map_texts

FIT_ROWS, FIT_WORDS = 3_000, 60
BUCKETS = 1 << 15
SEGMENT = 64
UNDETERMINED = "und"
#: Letters of scripts written without blanks (fixed values: Thai, Lao, Burmese, Khmer, kana, Han).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W\d_{UNSPACED}]+|(?=[^\W\d_])[{UNSPACED}]")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_features(word: str) -> list[int]:
    """Hashed affixes and inner n-grams, all of them, each number once."""
    framed = f"^{word}$"
    names = {framed[: k + 1] for k in (1, 2, 3)} | {framed[-k - 1:] for k in (1, 2, 3)}
    found = {1 + zlib.crc32(x.encode()) % (BUCKETS - 1) for x in names}
    found.update(1 + zlib.crc32(word[i: i + n].encode()) % (BUCKETS - 1) for n in (2, 3) for i in range(len(word) - n + 1))
    return sorted(found)


def feature_lists(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' features one behind the other, and where each word's begin; every word has some."""
    found = [word_features(word) for word in words]
    size = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((x for f in found for x in f), np.int32, int(size.sum())), np.cumsum(size) - size


def sums(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Summed weights (word x language) of each word's features."""
    if not len(starts):
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[flat], starts, axis=0, dtype=np.float64)


def _messages(emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward, backward (both b x t x k) and step sizes of equally long sequences."""
    b, t, k = emission.shape
    fwd, bwd, scale = np.empty_like(emission), np.empty_like(emission), np.empty((b, t))
    state = np.full((b, k), 1.0 / k)
    for i in range(t):
        state = (state @ trans if i else state) * emission[:, i]
        scale[:, i] = state.sum(1)
        state = state / scale[:, i, None]
        fwd[:, i] = state
    state = np.ones((b, k))
    for i in range(t - 1, -1, -1):
        bwd[:, i] = state
        state = (state * emission[:, i] / scale[:, i, None]) @ trans.T
    return fwd, bwd, scale


def train(sequences: np.ndarray, truth: np.ndarray, feats: tuple[np.ndarray, np.ndarray], lexicon: np.ndarray, *, steps: int = 40, rate: float = 0.15, l2: float = 1e-4):
    """Adam on the mean log-likelihood; sequences hold word numbers, truth labels (n x t)."""
    n, t = sequences.shape
    k = lexicon.shape[1]
    flat, starts = feats
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
    weights = {"w": np.zeros((BUCKETS, k)), "lex": np.ones(1), "trans": np.eye(k)}
    first = {name: np.zeros_like(x) for name, x in weights.items()}
    second = {name: np.zeros_like(x) for name, x in weights.items()}
    one_hot = np.eye(k)[truth]
    moves = np.zeros((k, k))
    np.add.at(moves, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    for step in range(1, steps + 1):
        score = sums(weights["w"], flat, starts) + weights["lex"] * lexicon
        score -= score.max(1, keepdims=True)
        trans = np.exp(weights["trans"] - weights["trans"].max())
        emission = np.exp(np.maximum(score, -30))[sequences]
        fwd, bwd, scale = _messages(emission, trans)
        gap = (one_hot - fwd * bwd).reshape(-1, k) / (n * t)
        pair = np.einsum("bti,btj->ij", fwd[:, :-1], emission[:, 1:] * bwd[:, 1:] / scale[:, 1:, None]) * trans
        by_word = np.stack([np.bincount(sequences.ravel(), gap[:, j], len(starts)) for j in range(k)], 1)
        grad_w = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS) for j in range(k)], 1)
        grads = {"w": grad_w - l2 * weights["w"], "lex": np.array([(by_word * lexicon).sum()]) - l2 * weights["lex"], "trans": (moves - pair) / (n * t) - l2 * weights["trans"]}
        for name, grad in grads.items():
            first[name] = 0.9 * first[name] + 0.1 * grad
            second[name] = 0.99 * second[name] + 0.01 * grad**2
            weights[name] += rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return weights


def fit(docs: DataFrame, *, rows: int = FIT_ROWS, fold: int = 4, held_out: int = 2, seed: int = 1) -> dict | None:
    """Weights learned from a bounded sample of rows with a known language."""
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held_out)
    )
    # Ids first, so that no text is sorted; at most ``rows`` ids come back.
    chosen = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = usable.join(F.broadcast(chosen.distinct()), "doc_id").select(F.struct("doc_id", "lang").alias("key"), "text")

    def cut(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = []
            for key, text in zip(keys, texts):
                words = words_of(text)
                at = zlib.crc32(str(key["doc_id"]).encode()) % max(1, len(words) - FIT_WORDS + 1)
                made.append((key["lang"], [w[:64] for w in words[at: at + FIT_WORDS]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string()))], names=["lang", "words"]
            )

    found = sorted((r[0], list(r[1])) for r in sample.mapInArrow(cut, "lang string, words array<string>").limit(4 * rows).collect() if r[1])
    langs = sorted({lang for lang, _ in found})
    if not langs:
        return None
    number = {w: i for i, w in enumerate(sorted({w for _, ws in found for w in ws}))}
    uses = [Counter() for _ in langs]
    for lang, ws in found:
        uses[langs.index(lang)].update(ws)
    # Leave-out smoothing keeps a word seen once from deciding by itself.
    lexicon = np.zeros((len(number), len(langs)))
    for w, i in number.items():
        counts = np.array([u[w] for u in uses], float)
        if counts.sum() > 1:
            lexicon[i] = np.log((counts + 0.5) / (counts.sum() + 0.5 * len(langs)))
    # Runs of ten words, shuffled, make sequences in which languages change.
    piece, rng = 10, np.random.default_rng(seed)
    runs = [(langs.index(lang), [number[w] for w in ws[i: i + piece]]) for lang, ws in found for i in range(0, len(ws) - piece + 1, piece)]
    if not runs:
        runs = [(langs.index(lang), (piece * [number[w] for w in ws])[:piece]) for lang, ws in found]
    order = rng.permutation(len(runs))
    half = [runs[i] for i in order[: len(order) // 3]]
    same = sorted((runs[i] for i in order[len(order) // 3:]), key=lambda r: r[0])
    runs = same + half
    runs = runs[: len(runs) // 3 * 3] or (runs * 3)[:3]
    sequences = np.array([w for _, ws in runs for w in ws]).reshape(-1, 3 * piece)
    truth = np.array([y for y, _ in runs for _ in range(piece)]).reshape(-1, 3 * piece)
    weights = train(sequences, truth, feature_lists(list(number)), lexicon)
    common = {w: lexicon[i].tolist() for w, i in number.items() if lexicon[i].any()}
    return {"langs": langs, "w": weights["w"].astype(np.float32), "lex": float(weights["lex"][0]), "trans": weights["trans"], "lexicon": common}


class Tagger:
    """Posterior languages of texts, with a bounded memory of emission scores."""

    def __init__(self, model: dict):
        self.langs, self.w = model["langs"], model["w"]
        self.trans = np.exp(model["trans"] - model["trans"].max())
        k = len(self.langs)
        self.lexicon = {w: np.array(x) * model["lex"] for w, x in model["lexicon"].items()}
        self.number: dict[str, int] = {}
        self.rows = np.empty((0, k))

    def learn(self, words: list[str]) -> None:
        # Parts of a bounded number of words and letters, but for a single long word.
        letters = np.cumsum([len(w) for w in words]) // 200_000
        cuts = [0, *(np.flatnonzero(np.diff(letters)) + 1).tolist(), len(words)] if words else [0]
        for first, last in zip(cuts, cuts[1:]):
            part = words[first:last]
            score = sums(self.w, *feature_lists(part))
            for i, word in enumerate(part):
                if word in self.lexicon:
                    score[i] += self.lexicon[word]
            score -= score.max(1, keepdims=True)
            self.number.update(zip(part, range(len(self.rows), len(self.rows) + len(part))))
            self.rows = np.concatenate([self.rows, np.exp(np.maximum(score, -30))])

    def emissions(self, words: list[str]) -> np.ndarray:
        number = self.number
        return self.rows[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Posterior of every language at every word of every text."""
        k = len(self.langs)
        if len(self.number) > 300_000:
            self.number, self.rows = {}, np.empty((0, k))
        self.learn(sorted({w for words in texts for w in words if w not in self.number}))
        size = np.array([len(words) for words in texts])
        each = -(-size // SEGMENT)
        total, first = int(each.sum()), np.cumsum(each) - each
        emission, real = np.ones((total * SEGMENT, k)), np.zeros(total * SEGMENT, bool)
        for words, at in zip(texts, (first * SEGMENT).tolist()):
            emission[at: at + len(words)] = self.emissions(words)
            real[at: at + len(words)] = True
        emission, real = emission.reshape(total, SEGMENT, k), real.reshape(total, SEGMENT)
        starts = np.zeros(total, bool)
        starts[first[each > 0]] = True
        # Transfer matrix of each segment; padding leaves it as it is.
        product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for i in range(SEGMENT):
            live = np.flatnonzero(real[:, i])
            moved = product[live] @ self.trans
            if i == 0:
                moved[starts[live]] = np.eye(k)  # no transition leads to the first word
            after = moved * emission[live, i][:, None, :]
            product[live] = after / after.sum((1, 2), keepdims=True)
        # Messages into each segment, one step per segment of the longest text.
        into, back = np.full((total, k), 1.0 / k), np.ones((total, k))
        for j in range(1, int(each.max(initial=0))):
            at = first[each > j] + j
            state = (into[at - 1][:, None, :] @ product[at - 1])[:, 0]
            into[at] = state / state.sum(1, keepdims=True)
        for j in range(int(each.max(initial=0)) - 2, -1, -1):
            at = first[each > j + 1] + j
            state = (product[at + 1] @ back[at + 1][:, :, None])[:, :, 0]
            back[at] = state / state.sum(1, keepdims=True)
        fwd = np.empty_like(emission)
        state = into
        for i in range(SEGMENT):
            moved = state @ self.trans
            if i == 0:
                moved[starts] = state[starts]
            after = moved * emission[:, i]
            state = np.where(real[:, i, None], after / after.sum(1, keepdims=True), state)
            fwd[:, i] = state
        state = back
        for i in range(SEGMENT - 1, -1, -1):
            both = fwd[:, i] * state
            before = (state * emission[:, i]) @ self.trans.T
            fwd[:, i] = both / both.sum(1, keepdims=True)
            state = np.where(real[:, i, None], before / before.sum(1, keepdims=True), state)
        flat = fwd.reshape(-1, k)
        return [flat[a: a + n] for a, n in zip((first * SEGMENT).tolist(), size.tolist())]


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def predict(docs: DataFrame, model: dict | None, *, fold: int = 4, held_out: int = 2) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, shares); shares hold each language's mean posterior."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    tagger = None

    def rows(ids, texts):
        nonlocal tagger
        if tagger is None and share.value is not None:
            tagger = Tagger(share.value)
        split = [[w for w in words_of(t) if w.isascii() or has_letter(w)] for t in texts]
        if tagger is None:
            for i in ids:
                yield i, UNDETERMINED, 0.0, []
            return
        for i, post in zip(ids, tagger.posteriors(split)):
            if not len(post):
                yield i, UNDETERMINED, 0.0, []
                continue
            mean = post.mean(0)
            best = int(mean.argmax())
            yield i, tagger.langs[best], min(1.0, float(mean[best])), list(zip(tagger.langs, mean.tolist()))

    found = map_texts(docs, "doc_id long, lang_pred string, score double, shares map<string,double>", rows, chunk_chars=4 << 20)
    return found.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), fold) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "shares"
    )


def language(docs: DataFrame, *, rows: int = FIT_ROWS) -> DataFrame:
    """Fit on the labelled sample and label every row of ``docs``."""
    return predict(docs, fit(docs, rows=rows))
