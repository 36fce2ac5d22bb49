"""Work that is done once, for a text or a word of the vocabulary, against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.functions.terms import word_counts
from newsloom.operators import classifier as cf
from newsloom.operators import keywords as kw
from newsloom.plans.staging import stage
from newsloom.registry import corpus as c


def test_words_are_sorted_as_plain_values(spark):
    rnd = random.Random(5)
    texts = [[rnd.choice(["a", "B", "aa", "é", "中", "\U0001f600", "1"]) for _ in range(n)] for n in (0, 1, 2, 9, 60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, words array<string>")
    found = rows.select("id", word_counts(F.col("words")).alias("counts"))
    assert "array_sort" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: [(w, n) for w, n in r.counts] for r in found.collect()}
    assert got == {i: sorted(Counter(words).items()) for i, words in enumerate(texts)}


def test_article_items_cut_texts_into_words_once(spark, tmp_path, monkeypatch):
    rnd = random.Random(6)
    words = [f"word{i}" for i in range(80)]
    texts = {i: "Title of all\n" + " ".join(rnd.choice(words) for _ in range(6)) for i in range(60)}
    spark.createDataFrame([(i, t, "en", "web") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0 + i, 2.0]) for i in range(7)], "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    calls, plain, vectors = [], c.segmented, {}
    monkeypatch.setattr(c, "segmented", lambda *args: calls.append(args) or plain(*args))
    chosen = c.word_vectors

    def kept(*args):
        found = chosen(*args)
        vectors.update({r.word: r.vec for r in found.collect()})
        return found

    monkeypatch.setattr(c, "word_vectors", kept)
    got = {r.id: (sorted(w.word for w in r.words), [round(x, 9) for x in r.vec]) for r in c.article_items(spark, str(tmp_path)).collect()}
    assert len(calls) == 2 and vectors
    want = {}
    for i, text in texts.items():
        held = Counter(text.lower().split())
        top = sorted(sorted(held, key=lambda w: (-held[w], w))[:10])
        if any(w in vectors for w in held):
            want[i] = top, [round(sum(n * vectors[w][k] for w, n in held.items() if w in vectors), 9) for k in range(2)]
    assert got == want


@pytest.fixture
def vocab(spark):
    return stage(spark.createDataFrame(
        [("a", [3.0, 4.0], 1.0, 5), ("b", [0.0, 2.0], 2.0, 6), ("z", [0.0, 0.0], 3.0, 7)],
        "word string, vec array<double>, idf double, corpus_tf long"))


@pytest.mark.parametrize("module, own, job", [
    (kw, "square", lambda terms, vocab: kw.word_centrality(kw.article_nouns(terms, vocab.select("word")), vocab).select("word", "sim")),
    (cf, "norm", lambda terms, vocab: cf.word_features(terms, vocab).select("word", F.col("tit_sim").alias("sim"))),
])
def test_a_words_own_product_is_made_for_the_vocabulary(spark, vocab, monkeypatch, module, own, job):
    seen, plain = [], module.scored_by_sums
    monkeypatch.setattr(module, "scored_by_sums", lambda rows, known, *args, **more: seen.extend(known.columns) or plain(rows, known, *args, **more))
    terms = spark.createDataFrame(
        [(1, 0, 0, "a", "n"), (1, 1, 0, "b", "n"), (1, 1, 1, "z", "n"), (1, 1, 2, "no", "n")],
        "id long, sentence int, pos int, word string, nature string")
    got = {r.word: round(r.sim, 9) for r in job(terms, vocab).collect()}
    assert own in seen
    assert got == ({"a": 8.0, "b": 8.0, "z": 0.0} if module is kw else {"a": 1.0, "b": round(8 / math.sqrt(25 * 4), 9), "z": 0.0})
