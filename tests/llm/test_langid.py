import itertools
import os

import numpy as np
import pytest
from rows import EDGES, documents, held_out

from newsloom.llm import langid as L

SF = "/root/testdata/sf0.01"


def model(k=3, seed=0):
    rng = np.random.default_rng(seed)
    return {"langs": [f"l{i}" for i in range(k)], "w": rng.normal(0, 0.3, (L.BUCKETS, k)), "lex": 1.0, "trans": rng.normal(0, 1, (k, k)), "lexicon": {}}


def test_posteriors_equal_enumeration(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 3)
    m = model()
    tagger = L.Tagger(m)
    texts = [["ab", "cd", "efg", "ab", "x", "yz", "cd"], [], ["ab"], ["x", "yz", "x", "efg"]]
    for words, got in zip(texts, tagger.posteriors(texts)):
        total = np.zeros((len(words), 3))
        emission = [m["w"][L.word_features(w)].sum(0) for w in words]
        for path in itertools.product(range(3), repeat=len(words)):
            z = sum(emission[i][y] for i, y in enumerate(path)) + sum(m["trans"][a, b] for a, b in zip(path, path[1:]))
            for i, y in enumerate(path):
                total[i, y] += np.exp(z)
        if words:
            np.testing.assert_allclose(got, total / total.sum(1, keepdims=True), atol=1e-9)
        else:
            assert len(got) == 0


def test_a_long_text_in_segments_equals_one_segment(monkeypatch):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcde"), 3)) for _ in range(1500)]
    short = L.Tagger(model()).posteriors([words])[0]
    monkeypatch.setattr(L, "SEGMENT", 2000)
    np.testing.assert_allclose(short, L.Tagger(model()).posteriors([words])[0], atol=1e-9)


def test_edge_rows(spark):
    rows = [(100 + i, "der die und das ist nicht " * 20 if i % 2 else "the and of that is not " * 20) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "de" if i % 2 else "en", "x") for i, t in rows], "doc_id long, text string, lang string, score string")
    edges = documents(spark, EDGES).select("doc_id", "text", "lang", "score")
    got = L.language(docs.unionByName(edges.withColumn("lang", edges.lang.substr(9, 1).cast("string")).where("true"))).collect()
    assert len(got) == len(rows) + len(EDGES)
    for r in got:
        assert r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1
        if r.doc_id in (1, 2, 3, 4):
            assert r.lang_pred == "und"
        elif r.doc_id is not None and r.doc_id >= 100:
            assert r.lang_pred == ("de" if r.doc_id % 2 else "en")
    assert L.language(documents(spark, [])).count() == 0


def test_all_features_of_a_word_count():
    assert L.words_of("Ab c1d 漢字かな ไทย x") == ["ab", "c", "d", "漢", "字", "か", "な", *"ไทย", "x"]
    word = "donaudampfschifffahrtsgesellschaftskapitän"
    grams = {word[i: i + n] for n in (2, 3) for i in range(len(word) - n + 1)}
    assert len(L.word_features(word)) > 0.95 * len(grams) > 60
    w = np.random.default_rng(1).normal(size=(L.BUCKETS, 3))
    words = [word, "a", "bc" * 500, "der"]
    got = L.sums(w, *L.feature_lists(words))
    assert np.allclose(got, [w[L.word_features(x)].sum(0) for x in words])
    tagger = L.Tagger({"langs": ["a", "b", "c"], "w": w, "lex": 1.0, "trans": np.zeros((3, 3)), "lexicon": {}})
    many = sorted({*words, "x" * 300_000, *(f"w{c}{d}" for c in "abcdef" for d in "abcdef")})
    tagger.learn(many)
    score = L.sums(w, *L.feature_lists(many))
    assert np.allclose(tagger.emissions(many), np.exp(np.maximum(score - score.max(1, keepdims=True), -30)))


def test_code_switched_text_is_labelled_by_word():
    langs = ["de", "en"]
    rng = np.random.default_rng(0)
    de, en = "der die und das ist nicht wir haben".split(), "the and of that is not we have".split()
    words = de + en
    feats = L.feature_lists(words)
    runs = rng.integers(0, 2, (200, 3))
    seqs = np.array([[8 * y + rng.integers(8) for y in row for _ in range(10)] for row in runs])
    truth = np.repeat(runs, 10, axis=1)
    w = L.train(seqs, truth, feats, np.zeros((16, 2)), steps=30)
    tagger = L.Tagger({"langs": langs, "w": w["w"], "lex": 1.0, "trans": w["trans"], "lexicon": {}})
    post = tagger.posteriors([de + en + de])[0].argmax(1)
    assert post.tolist() == [0] * 8 + [1] * 8 + [0] * 8


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in L.language(docs, rows=400).collect() if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97
