"""Vectors are neither sorted nor listed: words are put in the order of articles before they get theirs."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions.vectors import vec_sum_of
from newsloom.operators import classifier as cf
from newsloom.operators import keywords as kw
from newsloom.operators import textrank as tr
from newsloom.operators.category import doc_keyword_vector
from newsloom.operators.graphrank import article_rows, incoming_weights
from newsloom.plans.staging import stage


def steps(df):
    """The names of a plan's steps, the last one first."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [line.lstrip(" :+-*(0123456789)").split(" ")[0] for line in lines]


def sorted_before_join(df):
    found = steps(df)
    return "Sort" in found and found.index("BroadcastHashJoin") < found.index("Sort")


@pytest.fixture(scope="module")
def vocab(spark):
    rows = [(w, [float(i), 1.0], 0.5 + i, 3) for i, w in enumerate(["a", "b", "c", "d"])]
    return F.broadcast(stage(spark.createDataFrame(rows, "word string, vec array<double>, idf double, corpus_tf long")))


@pytest.fixture(scope="module")
def terms(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "b"), (1, 1, 1, "c"), (1, 1, 2, "d"), (2, 1, 0, "a"), (2, 1, 1, "a")]
    return spark.createDataFrame(rows, "id long, sentence int, pos int, word string").withColumn("nature", F.lit("n"))


def test_centrality(terms, vocab):
    central = kw.word_centrality(kw.article_nouns(terms, vocab.select("word")), vocab)
    assert sorted_before_join(central)
    got = {(r["id"], r["word"]): r["sim"] for r in central.collect()}
    # The sum of 0..3 and of four ones, less the word itself.
    assert got == {(1, "a"): 3.0, (1, "b"): 8.0, (1, "c"): 11.0, (1, "d"): 12.0, (2, "a"): 0.0}


def test_features(terms, vocab):
    assert sorted_before_join(cf.word_features(terms, vocab))


def test_graph_rows(terms, vocab):
    nodes = tr.word_graph(terms, vocab)
    assert "Generate" not in steps(nodes)
    assert {(r["id"], r["word"]): r["nbrs"] for r in nodes.collect()} == {
        (1, "a"): [], (1, "b"): [2, 3], (1, "c"): [1, 3], (1, "d"): [1, 2], (2, "a"): [],
    }
    assert sorted_before_join(article_rows(nodes, vocab))


def test_articles_across_batches(spark, terms, vocab):
    rows = article_rows(tr.word_graph(terms, vocab), vocab)
    want = sorted(incoming_weights(rows).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(incoming_weights(rows).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["id"], r["word"]): r["n"] for r in want} == {(1, "a"): 1, (1, "b"): 3, (1, "c"): 2, (1, "d"): 2}


def test_legacy_scaling_reads_its_rows_once(spark):
    df = spark.createDataFrame([(1, 5, "x", 2.0), (1, 3, "y", 4.0), (2, 1, "z", 1.0)], "id int, first int, word string, s double")
    scaled = kw.legacy_scale(df, "id", ["s"], "first")
    assert len([s for s in steps(scaled) if "Scan" in s]) == 1
    # high 4 and low 2 of article 1, high 1 and low 0 of article 2.
    assert {r["word"]: r["s"] for r in scaled.collect()} == {"x": 0.0, "y": 1.0, "z": 1.0}


def test_article_vectors(spark, vocab):
    words = spark.createDataFrame([(1, "A", 2.0), (1, "c", 1.0), (2, "d", 0.5), (3, "zz", 1.0)], "id int, word string, weight double")
    docs = doc_keyword_vector(words, vocab)
    assert not {"ObjectHashAggregate", "SortAggregate"} & set(steps(docs))
    assert {r["id"]: r["vec"] for r in docs.collect()} == {1: [2.0, 3.0], 2: [1.5, 0.5]}
    assert doc_keyword_vector(words, vocab.limit(0)).collect() == []
    with pytest.raises(Exception, match="differ in length"):
        vocab.agg(vec_sum_of(F.col("vec"), 3)).collect()


def test_words_held_twice_fail_nothing(terms, vocab):
    nodes = tr.word_graph(terms, vocab)
    rows = incoming_weights(article_rows(nodes, F.broadcast(vocab.unionByName(vocab)))).collect()
    assert {r["id"] for r in rows} == {1}
