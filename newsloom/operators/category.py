"""Category models: centroids, nearest-centroid classification, missing words."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.vectors import vec_scale, vec_sum, vec_sum_of, vec_unit
from newsloom.operators.assign import CHUNK_ROWS, match_centres
from newsloom.operators.stats import error_rates
from newsloom.plans.staging import broadcast_if_small, stage
from newsloom.sources.tables import write_table


def category_centroids(histogram: DataFrame, vecs: DataFrame, *, weighted: bool = True) -> DataFrame:
    """(cate, vec): mean of the category's keyword vectors, weighted by their counts.

    The divisor is the count of all keywords, with or without a vector. Unweighted:
    plain sum of the vectors. Words are looked up in lower case; a category without
    any known word has a null vector.
    """
    rows = histogram.select("cate", "n", F.lower("word").alias("word")).join(vecs, "word", "left")
    weight = F.col("n") if weighted else F.lit(1)
    known = F.when(F.col("vec").isNotNull(), weight)
    totals = rows.groupBy("cate").agg(F.sum("n").alias("total"))
    sums = (
        rows.where(F.col("vec").isNotNull())
        .groupBy("cate")
        .agg(vec_sum(F.col("vec"), known).alias("vec"))
    )
    joined = totals.join(sums, "cate", "left")
    if not weighted:
        return joined.select("cate", "vec")
    return joined.select("cate", vec_scale(F.col("vec"), 1 / F.col("total")).alias("vec"))


def doc_keyword_vector(keywords: DataFrame, vecs: DataFrame) -> DataFrame:
    """(id, vec): sum of the vectors of an article's keywords (id, word[, weight]).

    Articles without a known word are left out; join back to see them as null.
    """
    words = broadcast_if_small(vecs.select("word", "vec"))
    weight = F.col("weight") if "weight" in keywords.columns else None
    rows = keywords.withColumn("word", F.lower("word")).join(words, "word")
    some = vecs.where(F.col("vec").isNotNull()).select(F.size("vec")).first()
    return rows.groupBy("id").agg(vec_sum_of(F.col("vec"), some[0] if some else 0, weight).alias("vec"))


def nearest_centroid(docs: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, prediction, sim): the category with the highest cosine above zero, else "".

    ``docs`` is (id, vec), ``centroids`` (cate, vec); null vectors match nothing.
    """
    known = centroids.where(F.col("vec").isNotNull())
    table = stage(known.select(F.col("cate").alias("id"), vec_unit(F.col("vec")).alias("vec")))
    chunks = max(1, math.ceil(table.count() / CHUNK_ROWS))
    table = table.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    units = docs.where(F.col("vec").isNotNull()).select("id", vec_unit(F.col("vec")).alias("vec"))
    best = match_centres(units, table, threshold=0.0).select("id", F.col("centre").alias("prediction"), "sim")
    return docs.select("id").join(best, "id", "left").select(
        "id", F.coalesce("prediction", F.lit("")).alias("prediction"), F.coalesce("sim", F.lit(0.0)).alias("sim")
    )


def missing_vocabulary(keywords: DataFrame, vecs: DataFrame) -> DataFrame:
    """Distinct keywords that have no vector."""
    return keywords.select("word").distinct().join(vecs.select("word"), "word", "left_anti")


def train_test_split(df: DataFrame, key: str, train: float = 0.9, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: reproducible and independent of partitioning."""
    code = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10)
    in_train = code.cast("double") < F.lit(train * 2.0**32)
    return df.where(in_train), df.where(~in_train)


def publish_if(centroids: DataFrame, predicted: DataFrame, path: str, *, max_error: float) -> bool:
    """Writes the centroids when the overall error of (label, prediction) is below the gate."""
    overall = error_rates(predicted).where(F.col("level") == "all").first()
    good = overall is not None and overall["error_rate"] is not None and overall["error_rate"] < max_error
    if good:
        write_table(centroids, path)
    return good


def restrict_to_vocabulary(terms: DataFrame, keywords: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms whose word is known, and the keywords that occur in the kept terms."""
    # Its words are few beside the tokens, which so stay where they are read.
    kept = terms.join(broadcast_if_small(vocab.select("word")), "word", "left_semi")
    present = keywords.join(kept.select("id", "word").distinct(), ["id", "word"], "left_semi")
    return kept, present
