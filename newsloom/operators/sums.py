"""Sums of the vectors of an article's words, brought to each of these words."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.vectors import vec_sum, vec_sum_of
from newsloom.plans.staging import BROADCAST_BYTES, measured_bytes, stage

#: Room of a part, as parts are cut by a sample.
_SLACK = 1.25


def vocabulary_parts(vocab: DataFrame, size: int, limit: int) -> list[DataFrame]:
    """``vocab`` (word, idf, ...) in parts of about ``limit`` bytes at most, its most frequent words first."""
    number = math.ceil(_SLACK * size / limit)
    dealt = vocab.repartitionByRange(number, "idf", F.xxhash64("word")).withColumn("part", F.spark_partition_id())
    cut = stage(dealt)
    found = sorted(r["part"] for r in cut.select("part").distinct().collect())
    return [cut.where(F.col("part") == i).drop("part") for i in found]


def scored_by_sums(
    rows: DataFrame, vocab: DataFrame, score: Callable[[DataFrame], DataFrame], weight: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``score`` of the known rows (id, word, ...) with the columns of ``vocab`` and ``total``.

    ``vocab`` is (word, vec, idf, ...), staged; ``total`` is the sum of the vectors of the article's rows,
    each times ``weight`` (null, if all weights are zero and the vocabulary is large), and ``score`` gives rows
    without vectors.

    A vocabulary of up to ``limit`` bytes is broadcast: rows that come in the order of articles stay so, and no
    vector is shuffled or sorted. A larger one is broadcast in parts, one after another. A first pass over the
    rows adds up the vectors per article and part within tasks, and only those sums are shuffled; a second
    brings their totals to the rows, which get their vectors again. A row has vectors in passing only.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    size = measured_bytes(vocab)
    if size <= limit:
        found = rows.join(F.broadcast(vocab), "word")
        factor = None if weight is None else F.col(weight)
        return score(found.withColumn("total", vec_sum(F.col("vec"), factor, over=Window.partitionBy("id"))))
    # Parts see the rows again and again; these lie by article, so a task has few sums of each.
    rows = stage(rows)
    width = vocab.select(F.size("vec")).first()[0]
    parts = vocabulary_parts(vocab, size, limit)
    counted = rows if weight is None else rows.where(F.col(weight) != 0)
    factor = F.lit(1.0) if weight is None else F.col("weight")
    needed = counted.select("id", "word", *([] if weight is None else [F.col(weight).alias("weight")]))

    def union(found: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, found)

    sums = [
        stage(needed.join(F.broadcast(part.select("word", "vec")), "word").groupBy("id").agg(
            vec_sum_of(F.col("vec"), width, factor).alias("vec")))
        for part in parts
    ]
    totals = stage(union(sums).groupBy(F.col("id").alias("of")).agg(vec_sum_of(F.col("vec"), width).alias("total")))
    return union([
        stage(score(
            rows.join(F.broadcast(part.select("word")), "word", "left_semi")
            .join(totals, F.col("id").eqNullSafe(F.col("of")), "left").drop("of").join(F.broadcast(part), "word")
        ))
        for part in parts
    ])
