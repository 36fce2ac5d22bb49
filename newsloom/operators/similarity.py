"""Similarity between documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.vectors import vec_cosine, vec_dot, vec_unit
from newsloom.operators.blocks import block_count, block_pairs, lowest_partners
from newsloom.operators.stats import top_rows
from newsloom.plans.staging import stage


def doc_pair_similarity(docvecs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, dot, sim) for given pairs whose documents both exist."""
    a = docvecs.select(F.col("id").alias("id_a"), F.col("vec").alias("vec_a"))
    b = docvecs.select(F.col("id").alias("id_b"), F.col("vec").alias("vec_b"))
    return pairs.join(a, "id_a").join(b, "id_b").select(
        "id_a", "id_b",
        vec_dot(F.col("vec_a"), F.col("vec_b")).alias("dot"),
        vec_cosine(F.col("vec_a"), F.col("vec_b")).alias("sim"),
    )


def similar_documents(
    docvecs: DataFrame, query_id, *, threshold: float, limit: int | None = None
) -> DataFrame:
    """(id, sim) of documents whose cosine to the query document is above ``threshold``.

    The query vector reaches the scan as a scalar subquery, so nothing is joined or
    shuffled; ``limit`` keeps the smallest ids.
    """
    wanted = docvecs.where(F.col("id") == query_id).select("vec").scalar()
    found = (
        docvecs.withColumn("wanted", wanted)
        .withColumn("sim", vec_cosine(F.col("vec"), F.col("wanted")))
        .where(F.col("sim") > threshold)
        .drop("wanted")
    )
    return found if limit is None else found.orderBy("id").limit(limit)


def shared_words_rank(items: DataFrame, words: Sequence[str]) -> DataFrame:
    """Items with the number of words shared with, and joined with, a word list.

    Candidates rank by ``shared`` descending, then id; the alternative rank is by
    the size of the union.
    """
    wanted = F.array(*(F.lit(w) for w in dict.fromkeys(words)))
    own = F.array_distinct(F.col("words")["word"])
    return items.withColumns({
        "shared": F.size(F.array_intersect(own, wanted)),
        "joined": F.size(F.array_union(own, wanted)),
    })


def lowest_similarities(docvecs: DataFrame, *, k: int, flag_below: float = 0.8) -> DataFrame:
    """(id, rank, other, sim): the k least similar others of each document, at most ``flag_below``.

    The useful part of a similarity matrix: bounded per document, whatever the size of the set.
    """
    rows = stage(docvecs.select("id", vec_unit(F.col("vec")).alias("vec")))
    kind = rows.schema["id"].dataType.simpleString()
    low = block_pairs(
        rows, lowest_partners(k, flag_below), f"id {kind}, other {kind}, sim double", block_count(rows.count())
    )
    return top_rows(low, ["id"], [F.asc("sim"), F.asc("other")], k).select("id", "rank", "other", "sim")
