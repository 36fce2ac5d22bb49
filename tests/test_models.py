import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from newsloom.operators import buckets as bk
from newsloom.operators import category as cat
from newsloom.operators import classifier as cf
from newsloom.operators import stats as st
from newsloom.plans.staging import stage


def test_tfidf_and_stop_words(spark):
    df = spark.createDataFrame(
        [(1, ["a"], [["b", "a"]]), (2, [], [["a"]]), (3, [], [])],
        "id long, title_words array<string>, sentences array<array<string>>",
    )
    stats = st.tfidf_stats(df)
    rows = {r["word"]: (r["tf"], r["df"], round(r["idf"], 6)) for r in stats.collect()}
    assert rows == {"a": (3, 2, 0.405465), "b": (1, 1, 1.098612)}
    assert [r["word"] for r in st.stop_words(stats, idf_max=0.5).collect()] == ["a"]
    assert {r["word"] for r in st.stop_words(stats, idf_max=0.0, tf_min=2).collect()} == {"a"}


@pytest.mark.parametrize("bin_values", [3, 100_000])
def test_values_at_ranks_are_exact(spark, monkeypatch, bin_values):
    monkeypatch.setattr(bk, "BIN_VALUES", bin_values)
    rnd = random.Random(1)
    values = [0.0] * 40 + [rnd.choice([rnd.random(), rnd.random() * 1000]) for _ in range(80)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    ranks = [0, 1, 39, 40, 77, 119]
    got = {r["rank"]: r["value"] for r in bk.values_at_ranks(df, "v", ranks).collect()}
    assert got == {r: sorted(values)[r] for r in ranks}
    assert bk.quantile_cuts(df, ["v"])["v"] == [sorted(values)[int(i * 20.0)] for i in range(1, 6)]


def test_buckets(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (9.0,)], "v double")
    rows = df.select(bk.bucket_index(F.col("v"), [1.0, 2.0]).alias("b")).collect()
    assert [r["b"] for r in rows] == [0, 1, 1, 2, 2]
    hot = df.select(bk.one_hot(bk.bucket_index(F.col("v"), [1.0, 2.0]), 3).alias("h")).first()["h"]
    assert hot == [1.0, 0.0, 0.0]


def test_category_tables(spark):
    rows = [(1, "x", "a"), (1, "x", "b"), (2, "x", "a"), (3, "y", "c")]
    kw = spark.createDataFrame(rows, "id long, cate string, word string")
    hist = {(r["cate"], r["word"]): (r["n"], r["rank"]) for r in st.category_keyword_histogram(kw, top_n=1).collect()}
    assert hist == {("x", "a"): (2, 1), ("y", "c"): (1, 1)}
    profile = {r["cate"]: tuple(r)[1:] for r in st.category_profile(kw).collect()}
    assert profile == {"x": (2, 2, 2, "a:2,b:1"), "y": (1, 1, 1, "c:1")}
    summary = st.keyword_frequency_summary(kw, limits=(1,)).first()
    assert tuple(summary) == (2, 3, 1)


def test_centroids_and_nearest(spark, tmp_path):
    vecs = stage(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<double>"))
    hist = spark.createDataFrame(
        [("p,1", "A", 3), ("p,1", "zz", 1), ("q,1", "b", 2), ("r,1", "none", 1)], "cate string, word string, n long"
    )
    centroids = {r["cate"]: r["vec"] for r in cat.category_centroids(hist, vecs).collect()}
    assert centroids == {"p,1": [0.75, 0.0], "q,1": [0.0, 1.0], "r,1": None}
    plain = {r["cate"]: r["vec"] for r in cat.category_centroids(hist, vecs, weighted=False).collect()}
    assert plain["q,1"] == [0.0, 1.0]
    docs = cat.doc_keyword_vector(
        spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "x")], "id long, word string"), vecs
    )
    assert {r["id"]: r["vec"] for r in docs.collect()} == {1: [2.0, 0.0], 2: [0.0, 1.0]}
    more = docs.unionByName(spark.createDataFrame([(4, [-1.0, -1.0]), (5, None)], "id long, vec array<double>"))
    near = cat.nearest_centroid(more, cat.category_centroids(hist, vecs))
    assert {r["id"]: r["prediction"] for r in near.collect()} == {1: "p,1", 2: "q,1", 4: "", 5: ""}
    predicted = spark.createDataFrame([("p,1", "p,2"), ("p,1", "p,1"), ("q,1", "p,1")], "label string, prediction string")
    rates = {(r["level"], r["label"]): r["error_rate"] for r in st.error_rates(predicted).collect()}
    assert rates[("all", "")] == pytest.approx(2 / 3) and rates[("top", "")] == pytest.approx(1 / 3)
    assert rates[("label", "p,1")] == 0.5 and rates[("label", "q,1")] == 1.0
    path = str(tmp_path / "c")
    assert not cat.publish_if(vecs, predicted, path, max_error=0.6)
    assert cat.publish_if(vecs, predicted, path, max_error=0.7)
    assert spark.read.parquet(path).count() == 2
    assert [r["word"] for r in cat.missing_vocabulary(hist, vecs).where("word != 'A'").orderBy("word").collect()] == ["none", "zz"]


def test_split_is_stable(spark):
    df = spark.range(2000)
    train, test = cat.train_test_split(df, "id")
    assert train.count() + test.count() == 2000 and 1700 < train.count() < 1900
    moved, _ = cat.train_test_split(df.repartition(7), "id")
    assert moved.exceptAll(train).count() == 0


def labelled(spark, n=600, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        label = int(rnd.random() < 0.25)
        rows.append((
            i, f"w{i}", f"c{i % 3}", label, float(rnd.random() < 0.2 + 0.6 * label), float(rnd.random() < 0.5),
            rnd.random() + 0.4 * label, rnd.random() + label,
        ))
    return spark.createDataFrame(
        rows, "id long, word string, cate string, label int, in_title double, in_p1 double, tit_sim double, tfidf double"
    )


def test_balance_and_training(spark):
    rows = stage(labelled(spark))
    small = rows.where("label = 1").count()
    balanced = cf.balance_classes(rows, ["id", "word"])
    assert {r["label"]: r["count"] for r in balanced.groupBy("label").count().collect()} == {0: small, 1: small}
    fitted = cf.train_keyword_classifier(rows)
    metrics = cf.binary_metrics(fitted.predictions).first()
    assert metrics["auc"] > 0.85 and metrics["auc_hard"] > 0.7
    assert metrics["tp"] + metrics["fp"] + metrics["fn"] + metrics["tn"] == fitted.predictions.count()
    assert fitted.weights().count() == 1 + 2 + 2 + 6 + 6 + 3


def test_patterns_fit_as_their_rows(spark):
    """The model of the weighted patterns is that of the library over all single rows."""
    rows = stage(labelled(spark, n=900, seed=4))
    fitted = cf.train_keyword_classifier(rows)
    balanced = cf.balance_classes(rows, ["id", "word"]).withColumn("key", F.concat_ws(":", "id", "word"))
    training, _ = cat.train_test_split(cf.bucketed(balanced, fitted.cuts), "key")
    counted = cf.patterns(training)
    assert counted.agg(F.sum("n")).first()[0] == training.count() > counted.count()
    single = training.withColumn("flag_vec", array_to_vector("flags"))
    features = PipelineModel(fitted.model.stages[:3]).transform(single)
    plain = LogisticRegression(regParam=0.6, elasticNetParam=0.0, tol=1e-8, maxIter=200, standardization=True).fit(
        features.select("features", F.col("label").cast("double").alias("label"))
    )
    got = {r["position"]: r["weight"] for r in fitted.weights().collect()}
    assert got[-1] == pytest.approx(plain.intercept, abs=1e-4)
    assert [got[i] for i in range(len(got) - 1)] == pytest.approx(list(plain.coefficients), abs=1e-4)


def test_one_label_is_an_error(spark):
    with pytest.raises(ValueError):
        cf.balance_classes(labelled(spark).where("label = 1"), ["id", "word"])


def test_categories_stay_sparse(spark):
    cates = spark.range(20_000).select("id", F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("cate"))
    hot = cf.category_one_hot(cates).select("id", cf.hot_place(F.col("cate_vec")).alias("hot"), cf.vector_width(F.col("cate_vec")).alias("width"))
    assert hot.where("hot <> id or width <> 20000").count() == 0 and hot.count() == 20_000


def test_binary_metrics_guard(spark):
    scored = spark.createDataFrame([(0, 0.1), (1, 0.2)], "label int, score double")
    row = cf.binary_metrics(scored).first()
    assert (row["tp"], row["fn"], row["precision"], row["recall"], row["auc"]) == (0, 1, None, 0.0, 1.0)


def test_word_features(spark):
    terms = spark.createDataFrame(
        [(1, 0, 0, "a"), (1, 1, 0, "b"), (1, 1, 1, "a"), (1, 2, 0, "c"), (1, 2, 1, "?"), (2, 1, 0, "b")],
        "id long, sentence int, pos int, word string",
    )
    vocab = spark.createDataFrame(
        [("a", [1.0, 0.0], 1.0), ("b", [0.6, 0.8], 2.0), ("c", [0.0, 1.0], 3.0)], "word string, vec array<double>, idf double"
    )
    rows = {(r["id"], r["word"]): tuple(r)[2:] for r in cf.word_features(terms, vocab).collect()}
    assert rows[(1, "a")] == (1.0, 1.0, 1.0, 0.5)
    assert rows[(1, "b")] == (0.0, 1.0, 0.6, 0.5)
    assert rows[(1, "c")] == (0.0, 0.0, 0.0, 0.75)
    assert rows[(2, "b")] == (0.0, 1.0, 0.0, 2.0)
    keywords = spark.createDataFrame([(1, "a"), (2, "x")], "id long, word string")
    labels = {(r["id"], r["word"]): r["label"] for r in cf.label_rows(cf.word_features(terms, vocab), keywords).collect()}
    assert labels == {(1, "a"): 1, (1, "b"): 0, (1, "c"): 0, (2, "b"): 0}
