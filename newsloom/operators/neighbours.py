"""Nearest words by vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.blocks import BLOCK_ROWS, best_partners, block_count, block_pairs, low_partners
from newsloom.operators.stats import top_rows
from newsloom.plans.staging import stage


def _sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def word_neighbours(
    vecs: DataFrame,
    *,
    k: int = 24,
    threshold: float | None = 0.0,
    inclusive: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(word, rank, neighbour, score): the k most similar other words of each word.

    ``vecs`` is (word, vec) with unit vectors and one row per word. ``threshold`` is
    a lower bound on the similarity (strict unless ``inclusive``).
    """
    table = stage(vecs.select(F.col("word").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
    kind = _sql_type(table, "id")
    pairs = block_pairs(
        table, best_partners(k, threshold, inclusive),
        f"id {kind}, neighbour {kind}, score double", block_count(table.count(), block_rows),
    )
    best = top_rows(pairs, ["id"], [F.desc("score"), F.asc("neighbour")], k)
    return best.select(F.col("id").alias("word"), "rank", "neighbour", "score")


def pair_similarity(vecs: DataFrame, *, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, rank, neighbour, score): each unordered pair scored once and offered to
    both words, the k best kept per word."""
    return word_neighbours(vecs, k=k, threshold=None, block_rows=block_rows)


def low_similarity(docvecs: DataFrame, *, flag_below: float = 0.8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_low, low_share, lowest, lowest_id): how far each document of a set is
    from the others.

    The digest of the similarity matrix: ``n_low`` partners are at most
    ``flag_below``; ``lowest`` is the smallest similarity. Vectors have unit length.
    """
    table = stage(docvecs.select("id", F.col("vec").cast("array<double>").alias("vec")))
    rows = table.count()
    kind = _sql_type(table, "id")
    parts = block_pairs(
        table, low_partners(flag_below), f"id {kind}, n long, floor double, partner {kind}",
        block_count(rows, block_rows),
    )
    merged = parts.groupBy("id").agg(
        F.sum("n").alias("n_low"), F.min(F.struct("floor", "partner")).alias("low")
    )
    return merged.select(
        "id", "n_low", (F.col("n_low") / F.lit(max(rows - 1, 1))).alias("low_share"),
        F.col("low.floor").alias("lowest"), F.col("low.partner").alias("lowest_id"),
    )
