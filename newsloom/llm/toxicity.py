"""Toxicity from a learned lexicon, misspelled terms and the context of each hit.

Fitting reads a bounded sample of labelled rows (``FIT_ROWS``, by hash of the id). Terms whose
share of toxic documents stands out form a trie; its weights are smoothed log odds. A token is
folded (look-alike digits and signs) and its Levenshtein automaton is intersected with the trie:
the trie is walked while the automaton's state lives, so only prefixes within the error budget
are visited. Tokens that sample documents marked clean also use are no misspellings.

Each hit looks at a window of tokens and characters around it: quotation marks on both sides and
words of reporting make it a quotation, words of address make it abuse. A logistic regression
over the sums of abusive, misspelled and quoted hits and their densest window gives the score.

Edge cases: a null or empty text has no hits and gets the score of a text without hits; without
labelled rows of both kinds the score is the share of toxic rows (0.5 without rows); labels with
nulls aren't learned from; several labels of one id count each; an id of null is never held out
nor learned from; repeated rows are returned as often as they occur, an empty table gives no row.
Only ids, text and the label are read. Held-out rows take no part in fitting.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import crc_mod, map_texts, stage

FIT_ROWS = 20_000
MOST_TERMS = 1_000
#: Least log-likelihood ratio and log odds of a term.
LEAST_RATIO, LEAST_ODDS = 25.0, 3.0
#: Terms of a toxic document that explain it.
COVER = 3
CUT = 0.7
WINDOW = 12
#: Quotation marks (fixed values).
DOUBLE, SINGLE = "\"“”„«»", "‘’'"
#: Words near a hit that speak of reporting, and of addressing someone (fixed values).
REPORTING = frozenset(
    "said says wrote quoted quote called word term phrase slur insult sagte sagt schrieb wort zitat dit écrit mot "
    "citation dijo dice escribió palabra cita".split()
)
ADDRESS = frozenset("you your youre u du dich dir ihr euch sie tu toi te vous usted tú vosotros ustedes".split())
_FOLD = str.maketrans("@$0134578", "asoieastb")
_MARK = re.compile(f"[{DOUBLE}{SINGLE}]")
TOKEN = re.compile(r"[^\W\d_](?:[\w@$*]*[^\W_])?")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def error_budget(word: str) -> int:
    """Edits allowed in a word of this length, of a token as of a term."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class LevenshteinAutomaton:
    """Nondeterministic automaton of all strings within ``budget`` edits of a word.

    A state holds, for each number of edits, the places in the word reached so far as bits.
    """

    def __init__(self, word: str, budget: int):
        self.budget, self.end = budget, 1 << len(word)
        self.full = (self.end << 1) - 1
        self.places: dict[str, int] = {}
        for i, char in enumerate(word):
            self.places[char] = self.places.get(char, 0) | 1 << i

    def start(self) -> list[int]:
        return [(2 << e) - 1 for e in range(self.budget + 1)]

    def step(self, state: list[int], char: str) -> list[int] | None:
        """The next state; None once no place is left."""
        here, full = self.places.get(char, 0), self.full
        before = state[0]
        now = (before & here) << 1
        after = [now]
        for reached in state[1:]:
            # A match, a character too many, a wrong one, a missing one.
            now = ((reached & here) << 1 | before | before << 1 | now << 1) & full
            before = reached
            after.append(now)
        return after if now else None

    def distance(self, state: list[int]) -> int | None:
        return next((e for e, reached in enumerate(state) if reached & self.end), None)


class LexiconTrie:
    """Terms as nested dicts; the empty key holds a term's own spelling.

    ``heads``, ``tails`` and ``inner`` are the parts of terms of which one more stands than
    edits are allowed, so a token with none of them is far from every term.
    """

    def __init__(self, terms):
        self.root: dict = {}
        self.heads, self.tails, inner = set(), set(), set()
        for term in terms:
            node = self.root
            for char in term:
                node = node.setdefault(char, {})
            node[""] = term
            parts = error_budget(term) + 1
            if parts > 1:
                self.heads.add(term[: len(term) // parts])
                self.tails.add(term[len(term) * (parts - 1) // parts:])
                inner.update(term[len(term) * i // parts: len(term) * (i + 1) // parts] for i in range(1, parts - 1))
        self.head_sizes, self.tail_sizes = sorted({*map(len, self.heads)}), sorted({*map(len, self.tails)})
        self.inner = re.compile("|".join(map(re.escape, sorted(inner)))).search if inner else None

    def worth(self, word: str, budget: int) -> bool:
        """Whether some term may be within ``budget`` edits."""
        return (
            any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes)
            or (budget > 1 and self.inner is not None and self.inner(word) is not None)
        )

    def nearest(self, word: str, budget: int) -> tuple[str, int] | None:
        """Nearest term within its and the word's budget, the smaller spelling on ties."""
        machine, best = LevenshteinAutomaton(word, budget), None
        todo = [(self.root, machine.start())]
        while todo:
            node, state = todo.pop()
            for char, child in node.items():
                if char:
                    after = machine.step(state, char)
                    if after is not None:
                        todo.append((child, after))
                    continue
                d = machine.distance(state)
                if d is not None and d <= error_budget(child) and (best is None or (d, child) < best):
                    best = (d, child)
        return None if best is None else (best[1], best[0])


class Lexicon:
    """Weighted terms, with a bounded memory of tokens already looked up."""

    def __init__(self, weights: dict[str, float], clean: frozenset[str] = frozenset()):
        self.weights, self.clean = weights, clean
        self.trie = LexiconTrie(weights)
        self.known: dict[str, tuple[str, int] | None] = {}

    def find(self, token: str) -> tuple[str, int] | None:
        """(term, edits) of a token."""
        if token in self.known:
            return self.known[token]
        if len(self.known) > 500_000:
            self.known.clear()
        word = token if token.isalpha() else token.translate(_FOLD)
        hit = None
        if word in self.weights:
            hit = (word, 0 if word == token else 1)
        elif token not in self.clean and (budget := error_budget(word)) and self.trie.worth(word, budget):
            hit = self.trie.nearest(word, budget)
        self.known[token] = hit
        return hit


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between paired quotation marks, line by line, in order.

    A mark before a character opens, one behind a character closes the last open one of its kind
    (single or double); an apostrophe between letters or digits is no mark, nor is one that closes nothing.
    """
    spans, opened, at = [], {}, 0
    for m in _MARK.finditer(text):
        if text.find("\n", at, m.start()) >= 0:
            opened.clear()
        at = m.start()
        kind = m.group() in SINGLE
        before, after = text[at - 1: at] or " ", text[at + 1: at + 2] or " "
        if kind and before.isalnum() and after.isalnum():
            continue
        if kind in opened and not before.isspace():
            spans.append((opened.pop(kind), at))
        elif not after.isspace() and not (kind and before.isalnum()):
            opened[kind] = at
    return sorted(spans)


#: Features of a text, in order.
SIGNALS = ("plain", "misspelled", "quoted", "reported", "addressed", "hits", "densest", "density")


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Sums over the hits of a whole text, by the parts of their context windows (``SIGNALS``).

    How much each part says is left to the regression.
    """
    words = tokens(text)
    known, hits = lexicon.known, []
    for i, word in enumerate(words):
        hit = known[word] if word in known else lexicon.find(word)
        if hit is not None:
            hits.append((i, hit))
    if not hits:
        return [0.0] * len(SIGNALS)
    lower = text.lower()
    spans, quoted_spans = TOKEN.finditer(lower), quotations(lower)
    plain = wrong = quoted = reported = addressed = 0.0
    places, token, span = [], -1, None
    for i, (term, distance) in hits:
        while token < i:
            token, span = token + 1, next(spans)
        start = span.start()
        near = words[max(0, i - WINDOW): i] + words[i + 1: i + 1 + WINDOW]
        weight = lexicon.weights[term] * 0.6**distance
        at = bisect_right(quoted_spans, (start, len(lower)))
        if any(stop >= span.end() for _, stop in quoted_spans[max(0, at - 2): at]):
            quoted += weight
        elif any(w in REPORTING for w in near):
            reported += weight
        else:
            plain += weight
            wrong += weight if distance else 0.0
        if any(w in ADDRESS for w in near):
            addressed += weight
        places.append(i)
    densest = max(sum(1 for p in places[k: k + 50] if p - places[k] <= 2 * WINDOW) for k in range(len(places)))
    return [
        math.log1p(plain), math.log1p(wrong), math.log1p(quoted), math.log1p(reported), math.log1p(addressed),
        1.0, math.log(densest), math.log1p(1000 * len(hits) / len(words)),
    ]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: int, held_out: int, rows: int) -> DataFrame:
    """(label, text) of at most ``rows`` labelled documents outside the held-out fold."""
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != held_out))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    )
    # Bounded by ``rows`` pairs of numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")


def learn_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, most: int = MOST_TERMS) -> dict[str, float]:
    """Smoothed log odds of the terms that stand out in toxic documents.

    The log-likelihood ratio has to be far beyond chance for any of some million words.
    """
    found, share = [], n_toxic / max(1, n_toxic + n_clean)
    for word, a, b in counts:
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if len(word) < 3 or odds < LEAST_ODDS:
            continue
        n = a + b
        ratio = 2 * (a * math.log(a / (n * share)) + (b * math.log(b / (n * (1 - share))) if b else 0.0))
        if ratio >= LEAST_RATIO:
            found.append((-ratio, word, odds))
    return {word: odds for _, word, odds in sorted(found)[:most]}


def needed_terms(weights: dict[str, float], documents: set[frozenset[str]]) -> dict[str, float]:
    """The terms, strongest first, that help explain toxic documents, given by the terms they hold.

    A document with ``COVER`` chosen terms is explained. So a toxic document that was copied and
    edited a thousand times doesn't bring in its ordinary words beside the terms it holds.
    """
    held = {d: 0 for d in documents}
    chosen = {}
    for word, odds in weights.items():
        if any(n < COVER and word in d for d, n in held.items()):
            chosen[word] = odds
            for d in documents:
                held[d] += word in d
    return chosen


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, fold: int = 3, held_out: int = 1) -> dict:
    """Weights of terms and of the logistic regression, from a bounded sample."""
    sample = training_rows(docs, labels, "toxic", fold, held_out, rows)
    # Terms are counted over distinct lines, so that copies of a document don't vouch for their words.
    lines = stage(
        sample.select((F.col("y") > 0).cast("int").alias("y"), F.explode(F.split("text", "\n")).alias("text"))
        .groupBy("text").agg(F.min("y").alias("y"))
    )

    def count_words(ys, texts):
        seen = {0: Counter(), 1: Counter()}
        for y, text in zip(ys, texts):
            seen[y].update({w if w.isalpha() else w.translate(_FOLD) for w in tokens(text)})
        for word in seen[0].keys() | seen[1].keys():
            yield word, seen[1][word], seen[0][word]

    words = map_texts(lines, "word string, a long, b long", count_words, id_col="y", chunk_chars=64 << 20)
    total = dict(lines.groupBy((F.col("y") > 0).alias("t")).count().collect())
    n_toxic, n_clean = total.get(True, 0), total.get(False, 0)
    summed = words.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    strong = summed.where((F.col("a") >= 3) & (F.col("a") * (n_clean + 1) > 3 * F.col("b") * (n_toxic + 1)))
    # Strongest first, so what comes to the driver is bounded.
    counts = [tuple(r) for r in strong.orderBy(F.desc("a"), "word").limit(20 * MOST_TERMS).collect()]
    weights = learn_terms(counts, n_toxic, n_clean)

    def held_terms(ys, texts):
        for text in texts:
            yield (sorted({w for w in (t if t.isalpha() else t.translate(_FOLD) for t in tokens(text)) if w in weights}),)

    # Lists of known terms, at most a list for each row of the sample.
    explained = map_texts(sample.where("y > 0"), "terms array<string>", held_terms, id_col="y").distinct()
    weights = needed_terms(weights, {frozenset(r[0]) for r in explained.collect()})
    if not weights or not n_toxic or not n_clean:
        ys = dict(sample.groupBy((F.col("y") > 0).alias("t")).count().collect())
        base = (ys.get(True, 0) + 0.5) / (sum(ys.values()) + 1)
        return {"terms": {}, "clean": frozenset(), "w": [0.0] * len(SIGNALS) + [math.log(base / (1 - base))]}
    bare = Lexicon(weights)

    def near_misses(ys, texts):
        seen = Counter()
        for y, text in zip(ys, texts):
            if y == 0:
                for w in set(tokens(text)):
                    if bare.find(w) is not None and w not in weights:
                        seen[w] += 1
        yield from seen.items()

    # Misspelling-like tokens of clean documents: few, as they're near a term.
    rows_of = map_texts(lines, "word string, n long", near_misses, id_col="y", chunk_chars=64 << 20)
    clean = frozenset(r[0] for r in rows_of.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(50 * MOST_TERMS).collect())
    lexicon = Lexicon(weights, clean)
    table = map_texts(
        sample, "y int, x array<double>", lambda ys, texts: [(y, features(t, lexicon)) for y, t in zip(ys, texts)], id_col="y"
    ).collect()
    table = sorted((int(r[0] > 0), list(r[1])) for r in table)
    w = logistic(np.array([x for _, x in table]), np.array([y for y, _ in table], float))
    return {"terms": weights, "clean": clean, "w": w.tolist()}


def score(docs: DataFrame, model: dict, *, fold: int = 3, held_out: int = 1, cut: float = CUT) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, signals); signals are the sums behind the score."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    lexicon = None

    def rows(ids, texts):
        nonlocal lexicon
        if lexicon is None:
            lexicon = Lexicon(share.value["terms"], share.value["clean"])
        w = share.value["w"]
        for i, text in zip(ids, texts):
            x = features(text, lexicon)
            z = sum(a * b for a, b in zip(x, w)) + w[-1]
            yield i, 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), x

    scored = map_texts(docs, "doc_id long, score double, signals array<double>", rows)
    return scored.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), fold) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"), "signals",
    )


def toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS) -> DataFrame:
    """Fit on the labelled sample and score every row of ``docs``."""
    return score(docs, fit(docs, labels, rows=rows))
