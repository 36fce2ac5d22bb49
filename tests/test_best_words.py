"""Words that are too many to be broadcast are looked up by frequency."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import stats
from newsloom.operators.stats import best_words, category_profile, frequent_from, keyword_frequency_summary, top_rows
from newsloom.plans.staging import stage


def rows(spark):
    """60 articles, one id in two rows, one without id; words of every frequency, some unknown, many ties."""
    ids = [*range(58), 7, None]
    found = [
        (i, f"c{n % 3}", f"w{j}", 1 + (n * j) % 4)
        for n, i in enumerate(ids) for j in range(1, 61) if n % j == 0 or (n + j) % 17 == 0
    ]
    return spark.createDataFrame(found, "id long, category string, word string, tf long")


def known(counted):
    df = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return stage(df.where("df >= 2").withColumn("idf", F.log(F.lit(60.0) / F.col("df"))))


@pytest.mark.parametrize("limit", [0, 300, 1000, 1 << 20])
def test_best_words_equal_a_plain_ranking(spark, limit):
    counted = rows(spark)
    words = known(counted)
    scored = counted.join(words.drop("df"), "word").withColumn("score", F.round(F.col("tf") * F.col("idf"), 6))
    plain = top_rows(scored, ["id"], [F.desc("score"), F.asc("word")], 5)
    got = best_words(counted, words, 5, limit)
    key = ["id", "rank", "word", "score"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, plain.select(key).collect()))


def test_frequent_words_fit_the_limit(spark):
    words = spark.createDataFrame([("aa", 2), ("bb", 3), ("cc", 4), ("dd", 9)], "word string, df long")
    assert [frequent_from(words, n) for n in (1000, 120, 50)] == [1, 4, 8]
    assert frequent_from(words, 0) > 9


def test_few_rows_of_an_article_are_shuffled(spark, monkeypatch):
    """An article of 1,990 frequent words passes on its best ones, and no rare word that can't reach them."""
    written = []
    monkeypatch.setattr(stats, "stage", lambda df: written.append(stage(df)) or written[-1])
    counted = spark.range(0, 2000, 1, 1).selectExpr("1L as id", "concat('w', id) as word", "if(id < 1990, 1 + id, 1) as tf")
    words = stage(spark.range(2000).selectExpr("concat('w', id) as word", "if(id < 1990, 8L, 2L) as df", "if(id < 1990, 1D, 2D) as idf"))
    assert frequent_from(words, 104_500) == 8
    got = best_words(counted, words, 5, 104_500)
    assert [r["word"] for r in got.orderBy("rank").collect()] == [f"w{i}" for i in range(1989, 1984, -1)]
    assert [df.count() for df in written] == [5]


def test_keywords_are_read_once(spark):
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    keywords = spark.createDataFrame([(i, f"c{i % 2}", f"w{i % 5}") for i in range(20)], "id long, cate string, word string")
    read = keywords.mapInArrow(count, keywords.schema)
    summary = keyword_frequency_summary(read, limits=(3,)).first()
    assert tuple(summary) == (2, 5, 5) and met.value == 20
    profile = {r["cate"]: r["artsize"] for r in category_profile(read).collect()}
    assert profile == {"c0": 10, "c1": 10} and met.value == 40
