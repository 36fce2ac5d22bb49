import base64

import pytest
from pyspark.sql import functions as F

from newsloom.plans.staging import stage
from newsloom.sources import articles as src
from newsloom.sources import tables


def raw(spark):
    body = lambda s: base64.b64encode(s.encode()).decode()
    return spark.createDataFrame(
        [
            (3, "t3", body("x\ny"), "a,b", "c,d", 2), (1, "t1", body("é"), "a", "c", 2),
            (2, "t2", body("z"), "", "c", 2), (4, "t4", body("z"), "a", "c", 1), (None, "t", body("z"), "a", "c", 2),
        ],
        "fid long, ftitle string, fcontent string, fkeywords string, fcategory string, fresource_type int",
    )


def test_read_articles_filters_and_decodes(spark):
    rows = src.read_articles(raw(spark)).orderBy("id").collect()
    assert [(r["id"], r["content"], r["keywords"]) for r in rows] == [(1, "é", ["a"]), (3, "x\ny", ["a", "b"])]
    assert [r["id"] for r in src.read_articles(raw(spark), limit=1).collect()] == [1]
    assert [r["id"] for r in src.read_articles(raw(spark), id_range=(1, 4)).collect()] == [3]


def test_segment_articles_keeps_one_row_per_id(spark):
    df = spark.createDataFrame(
        [(1, "B t", "x y\n\nz"), (1, "A t", "q"), (2, None, "w")], "id long, title string, content string"
    )
    rows = {r["id"]: (r["title_words"], r["sentences"]) for r in src.segment_articles(df).collect()}
    assert rows == {1: (["a", "t"], [["q"]]), 2: ([], [["w"]])}


def test_only_texts_of_repeated_ids_are_shuffled(spark, capsys):
    # A third of the rows under one id, and one row without.
    rows = [(i if i % 3 else 0, f"t{i}", f"c{i}") for i in range(1, 61)] + [(None, "x", "y"), (None, "w", "z")]
    df = stage(spark.createDataFrame(rows, "id long, title string, content string"))
    got = src.one_row_per_id(df)
    want = {}
    for i, *text in rows:
        want[i] = min(want.get(i, text), text)
    assert {r["id"]: [r["title"], r["content"]] for r in got.collect()} == want and got.count() == len(want)
    got.explain("formatted")
    plan = capsys.readouterr().out
    unique = plan.split("Union")[1].split("HashAggregate")[0].split("SortAggregate")[0]
    assert "BroadcastHashJoin LeftAnti" in unique and "Exchange hashpartitioning" not in unique
    unique_ids = stage(df.where("id > 0"))
    assert src.one_row_per_id(unique_ids) is unique_ids


def test_catalog_table_replaces_partitions(spark, tmp_path):
    spark.sql(f"CREATE DATABASE catalog_test LOCATION '{tmp_path}/db'")
    put = lambda rows, kind: tables.write_catalog_table(spark.createDataFrame(rows, kind), "catalog_test.t")
    put([("a", 1, "x"), ("b", 2, "y")], "run_id string, n int, word string")
    put([("z", 3, "a")], "word string, n int, run_id string")
    read = lambda: sorted(tuple(r) for r in spark.table("catalog_test.t").select("run_id", "word", "n").collect())
    assert read() == [("a", "z", 3), ("b", "y", 2)]
    for rows, kind in [([("a", 1)], "run_id string, n int"), ([("a", 1, 2)], "run_id string, n int, word int")]:
        with pytest.raises(ValueError):
            put(rows, kind)
    assert len(read()) == 2


def test_terms_with_lexicon_and_encoding(spark):
    df = spark.createDataFrame([(1, "a b", "c d\ne")], "id long, title string, content string")
    seg = src.segment_articles(df)
    lexicon = spark.createDataFrame([("c", "v")], "word string, nature string")
    long = {(r["sentence"], r["pos"]): (r["word"], r["nature"]) for r in src.to_terms(seg, lexicon=lexicon).collect()}
    assert long == {
        (0, 0): ("a", "n"), (0, 1): ("b", "n"), (1, 0): ("c", "v"), (1, 1): ("d", "n"), (2, 0): ("e", "n")
    }
    encoded = src.encode_segmented(seg)
    assert encoded.first()["content"] == "c/n,d/n,###,e/n"
    vocabulary = spark.createDataFrame([("d",), ("a",)], "word string")
    back = tables.read_segmented(encoded, vocabulary).collect()
    assert sorted((r["sentence"], r["word"]) for r in back) == [(0, "a"), (1, "d")]


def test_read_word_vectors_and_docvecs(spark):
    vecs = spark.createDataFrame([("ab", "3,4"), ("c", "1,0"), ("stop", "1,1"), ("odd", "1")], "word string, vec string")
    drop = spark.createDataFrame([("stop",)], "word string")
    rows = tables.read_word_vectors(vecs, drop=drop, min_len=2, dim=2).collect()
    assert [(r["word"], r["vec"]) for r in rows] == [("ab", [0.6, 0.8])]
    docs = spark.createDataFrame([("1,2,", "a:2.0,", "1,2,"), ("3,", "b:1.0,", "0,1,")], "id string, words string, vec string")
    kept = tables.read_docvecs(docs, reset_weights=False, drop=2).collect()
    assert kept[0]["ids"] == ["1", "2"] and kept[0]["words"][0]["weight"] == 2.0 and len(kept) == 1


def test_write_table_replaces_one_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.range(3), spark.range(5)
    tables.write_table(one, path, run_id="a")
    tables.write_table(one, path, run_id="b")
    tables.write_table(two, path, run_id="a")
    counts = {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()}
    assert counts == {"a": 5, "b": 3}


def test_run_names():
    assert tables.weights_run_id({"u": 2, "p": 8, "i": 0}) == "p8_u2_2"
    assert tables.weights_run_id({"s": 10}, test=True) == "s10_1"
    assert tables.cluster_run_id(10, 100000, 200, 0.9, 20170701) == "10_100000_200_09_20170701"


def test_keyword_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('"k","<b>t</b>","u","a ""q""\n</p>b"\n', encoding="utf-8")
    row = src.read_keyword_sheet(spark, str(tmp_path / "s.csv")).first()
    assert (row["keyword"], row["title"].strip(), row["article"]) == ("k", "t", 'a "q" b')


def test_word_stats(spark):
    stats = spark.createDataFrame([("a", 2, 1.5), ("b", None, 1.0)], "word string, tf long, idf double")
    assert [tuple(r) for r in tables.read_word_stats(stats, weight="tf_idf").collect()] == [("a", 3.0)]
    assert tables.read_word_stats(stats.select("word", F.lit(1).alias("tf"), "idf")).count() == 2
