"""Sums over a vocabulary too large to be broadcast, against the broadcast of the whole."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import classifier as cf
from newsloom.operators import keywords as kw
from newsloom.operators import sums
from newsloom.plans.staging import stage


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    words = [f"w{i:02d}" for i in range(40)]
    vocab = [(w, [rnd.gauss(0, 1) for _ in range(3)], 0.1 * i, i) for i, w in enumerate(words)]
    terms = [
        (i if i else None, sentence, pos, rnd.choice([*words, "other"]), "n")
        for i in range(30) for sentence in range(3) for pos in range(rnd.randint(0, 6))
    ]
    return (
        spark.createDataFrame(terms, "id long, sentence int, pos int, word string, nature string"),
        stage(spark.createDataFrame(vocab, "word string, vec array<double>, idf double, corpus_tf long")),
    )


@pytest.mark.parametrize("job", [
    lambda terms, vocab: kw.word_centrality(kw.article_nouns(terms, vocab.select("word")), vocab),
    lambda terms, vocab: cf.word_features(terms, vocab),
])
def test_parts_of_a_large_vocabulary(tables, job, monkeypatch):
    whole = job(*tables)
    monkeypatch.setattr(sums, "BROADCAST_BYTES", 1500)
    parts = job(*tables)
    assert parts.columns == whole.columns

    def rows(df):
        shown = [F.round(c, 8).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
        return sorted(map(repr, df.select(shown).collect()))

    assert rows(parts) == rows(whole)
    assert whole.where("id is null").count() > 0


def test_a_large_vocabulary_comes_in_parts(tables, monkeypatch):
    parts = sums.vocabulary_parts(tables[1], 6000, 1500)
    assert len(parts) > 2
    idfs = [[r["idf"] for r in part.collect()] for part in parts]
    assert sorted(x for part in idfs for x in part) == sorted(r["idf"] for r in tables[1].collect())
    assert all(max(a) <= min(b) for a, b in zip(idfs, idfs[1:]))


def test_labels_leave_features_where_they_are(spark):
    features = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "id long, word string").repartition("id")
    found = cf.label_rows(features, spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "a")], "id long, word string"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, features.withColumn(
        "label", F.when(F.expr("id = 1 and word = 'a'"), 1).otherwise(0)).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "hashpartitioning(id#" in plan and ", word#" not in plan.split("hashpartitioning(")[1].split(")")[0]
