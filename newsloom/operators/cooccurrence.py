"""Word pairs that occur close together, and word expansion by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.stats import top_rows
from newsloom.plans.staging import broadcast_if_small, stage


def _near_pairs(words: Column, distance: int) -> Column:
    n = F.greatest(F.size(words) - distance, F.lit(0))
    return F.zip_with(
        F.slice(words, F.lit(1), n),
        F.slice(words, F.lit(1 + distance), n),
        lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")),
    )


def cooccurrence_pairs(paragraphs: DataFrame, *, window: int = 5) -> DataFrame:
    """(a, b, n): unordered pairs of different words within ``window`` positions.

    ``paragraphs`` has one ``words`` array per row. The pairs come from the array
    itself, so the only shuffle is the map-side combined count.
    """
    near = F.concat(*(_near_pairs(F.col("words"), d) for d in range(1, window)))
    pairs = (
        paragraphs.select("words")
        .where(F.size("words") > 1)
        .select(F.explode(near).alias("p"))
        .select("p.a", "p.b")
        .where(F.col("a") != F.col("b"))
    )
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _both_sides(pairs: DataFrame) -> DataFrame:
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("partner")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("partner")),
    )
    return pairs.select(F.explode(sides).alias("s"), "n").select("s.word", "s.partner", "n")


def window_tf(pairs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, tf): summed counts of the pairs holding a word; 0 for other vocabulary."""
    tf = _both_sides(pairs).groupBy("word").agg(F.sum("n").alias("tf"))
    if vocabulary is None:
        return tf
    return vocabulary.select("word").join(tf, "word", "left").fillna(0, ["tf"])


def cooccurrence_expansion(pairs: DataFrame, *, k: int = 20) -> DataFrame:
    """(word, rank, neighbour, score): partners by n(a,b) / (tf(a) * tf(b)).

    Pairs are scored once, and given to both words only for the limited ranking.
    """
    pairs = stage(pairs)
    tf = broadcast_if_small(stage(window_tf(pairs)))
    scored = pairs.join(tf.select(F.col("word").alias("a"), F.col("tf").alias("own")), "a").join(
        tf.select(F.col("word").alias("b"), F.col("tf").alias("other")), "b"
    ).select("a", "b", (F.col("n").cast("double") / (F.col("own").cast("double") * F.col("other").cast("double"))).alias("n"))
    best = top_rows(
        _both_sides(scored).select("word", F.col("partner").alias("neighbour"), F.col("n").alias("score")),
        ["word"], [F.desc("score"), F.asc("neighbour")], k,
    )
    return best.select("word", "rank", "neighbour", "score")


def expansion_lists(expansion: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, partners): ranked (word, score) partners; every vocabulary word has a row."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "neighbour", "score")))
    lists = expansion.groupBy("word").agg(
        F.transform(
            listed, lambda r: F.struct(r["neighbour"].alias("word"), r["score"].alias("score"))
        ).alias("partners")
    )
    none = F.array().cast("array<struct<word:string,score:double>>")
    return vocabulary.select("word").join(lists, "word", "left").withColumn(
        "partners", F.coalesce("partners", none)
    )
