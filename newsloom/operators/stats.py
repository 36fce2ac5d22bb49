"""Corpus statistics over segmented articles, and category keyword profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.terms import is_vocabulary_nature, word_counts
from newsloom.plans.staging import BROADCAST_BYTES, stage
from newsloom.sources.articles import article_words

#: Bytes of a broadcast row (word, idf) beside those of the word.
_WORD_ROW = 48


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def tfidf_stats(segmented: DataFrame) -> DataFrame:
    """(word, tf, df, idf): occurrences, articles holding the word, ln(N / df).

    An article's words are counted inside its row; what is shuffled are map-side
    combined counts per word.
    """
    counts = article_counts(segmented).groupBy("word").agg(
        F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")
    )
    articles = segmented.agg(F.count(F.lit(1)).cast("double")).scalar()
    return counts.withColumn("idf", F.log(articles / F.col("df")))


def article_counts(segmented: DataFrame, *extra: str) -> DataFrame:
    """(id, total, word, tf): words of each article with their counts, without a shuffle."""
    words = article_words(segmented, *extra).withColumn("total", F.size("words"))
    counted = words.select("id", *extra, "total", F.explode(word_counts(F.col("words"))).alias("c"))
    return counted.select("id", *extra, "total", "c.word", F.col("c.n").alias("tf"))


def stop_words(stats: DataFrame, *, idf_max: float = 3.0, tf_min: int = 165943) -> DataFrame:
    return stats.where((F.col("idf") <= idf_max) | (F.col("tf") > tf_min)).select("word")


def doc_tf(segmented: DataFrame, *extra: str) -> DataFrame:
    """(id, word, tf, rel_tf): occurrences in the article, and their share of its words."""
    return article_counts(segmented, *extra).select(
        "id", *extra, "word", "tf", (F.col("tf") / F.col("total")).alias("rel_tf")
    )


def frequent_from(known: DataFrame, limit: int = BROADCAST_BYTES) -> int:
    """Least power of two from which on the words of ``known`` (word, df) fit ``limit`` bytes."""
    level = F.floor(F.log2("df")).cast("int").alias("level")
    sizes = known.groupBy(level).agg(F.sum(F.octet_length("word") + _WORD_ROW).alias("size")).collect()
    least, total = 1 << 62, 0
    for row in sorted(sizes, key=lambda r: -r["level"]):
        total += row["size"]
        if total > limit:
            return least
        least = 1 << row["level"]
    return 1


def _within_reach(rows: DataFrame, k: int) -> DataFrame:
    """Rows (id, upper, known, ...) less those below ``k`` known rows that stand by them with the same id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            upper = batch.column("upper").to_numpy()
            at = np.flatnonzero(batch.column("known").to_numpy(zero_copy_only=False))
            at = at[np.lexsort((-upper[at], ids[at]))]
            # Where k places on the same article still stands, that row is its k-th.
            first = np.flatnonzero(np.r_[True, ids[at][1:] != ids[at][:-1]]) if len(at) else at
            kth = first + k - 1
            kth = kth[(kth < len(at))]
            kth = kth[ids[at][kth] == ids[at][kth - k + 1]]
            least = np.full(len(ids), -np.inf)
            least[ids[at][kth]] = upper[at][kth]
            yield batch.filter(pa.array(upper >= least[ids]))

    return rows.mapInArrow(run, rows.schema)


def best_words(counted: DataFrame, known: DataFrame, k: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The ``k`` rows of each article in (id, word, tf, ...) with the highest score tf * idf, in ``rank`` order.

    ``known`` is (word, df, idf), staged; other words don't count. Its frequent words, ``limit`` bytes at
    most, are broadcast, so a task has nearly all scores of an article before any shuffle. It passes on the
    best of them, and of the rare words those that could still be among the best at the highest idf of all;
    only these are joined by a shuffle. No article's words are sorted as a whole.
    """
    least = frequent_from(known, limit)
    often, rest = (known.where(part).select("word", "idf") for part in (F.col("df") >= least, F.col("df") < least))
    top = rest.agg(F.max("idf")).first()[0] if least > 1 else None
    found = counted.join(F.broadcast(often), "word", "inner" if top is None else "left")
    score = F.round(F.col("tf") * F.col("idf"), 6)
    found = _within_reach(found.withColumns({
        "known": F.col("idf").isNotNull(), "upper": F.coalesce(score, F.round(F.col("tf") * F.lit(top or 0.0), 6)),
    }), k)
    if top is not None:
        found = stage(found)
    scored = found.where("known").drop("known", "upper")
    if top is not None:
        scored = scored.unionByName(found.where("not known").drop("known", "upper", "idf").join(rest, "word"))
    return top_rows(scored.withColumn("score", score), ["id"], [F.desc("score"), F.asc("word")], k)


def corpus_word_count(segmented: DataFrame) -> DataFrame:
    return article_counts(segmented).groupBy("word").agg(F.sum("tf").alias("n"))


def noun_vocabulary(terms: DataFrame) -> DataFrame:
    rows = terms.where(is_vocabulary_nature(F.col("nature")) & ~F.col("word").contains("/"))
    return rows.select("word").distinct()


def category_keyword_histogram(keywords: DataFrame, *, top_n: int = 20) -> DataFrame:
    """(cate, word, n, rank): most used keywords of each category of (id, cate, word)."""
    counts = keywords.groupBy("cate", "word").agg(F.count(F.lit(1)).alias("n"))
    return top_rows(counts, ["cate"], [F.desc("n"), F.asc("word")], top_n)


def category_profile(keywords: DataFrame, *, top_n: int = 100) -> DataFrame:
    """(cate, artsize, keysize, reprekeysize, reprekeys) of (id, cate, word)."""
    keywords = stage(keywords)
    counts = keywords.groupBy("cate", "word").agg(F.count(F.lit(1)).alias("n"))
    keysize = counts.groupBy("cate").agg(F.count(F.lit(1)).alias("keysize"))
    artsize = (
        keywords.select("cate", "id").distinct().groupBy("cate").agg(F.count(F.lit(1)).alias("artsize"))
    )
    best = top_rows(counts, ["cate"], [F.desc("n"), F.asc("word")], top_n)
    listed = F.array_sort(F.collect_list(F.struct("rank", "word", "n")))
    representatives = best.groupBy("cate").agg(
        F.count(F.lit(1)).alias("reprekeysize"),
        F.array_join(
            F.transform(listed, lambda r: F.concat_ws(":", r["word"], r["n"].cast("string"))), ","
        ).alias("reprekeys"),
    )
    return artsize.join(keysize, "cate").join(representatives, "cate").select(
        "cate", "artsize", "keysize", "reprekeysize", "reprekeys"
    )


def keyword_frequency_summary(keywords: DataFrame, limits: tuple[int, ...] = (100, 500, 1000)) -> DataFrame:
    """One row: categories, distinct keywords, keywords used more often than each limit.

    Uses are counted by word and category once, and both sums made from that.
    """
    counts = stage(keywords.groupBy("word", "cate").agg(F.count(F.lit(1)).alias("n")))
    uses = counts.groupBy("word").agg(F.sum("n").alias("n"))
    over = [F.count(F.when(F.col("n") > m, 1)).alias(f"over_{m}") for m in limits]
    cates = counts.agg(F.countDistinct("cate")).scalar()
    return uses.agg(F.count(F.lit(1)).alias("keywords"), *over).select(
        cates.alias("categories"), "keywords", *(f"over_{m}" for m in limits)
    )


def error_rates(predicted: DataFrame) -> DataFrame:
    """(level, label, n, error_rate) of (label, prediction).

    Levels: ``all``, ``top`` (first comma level of the label) and one ``label`` row each.
    """
    wrong = F.when(F.col("label") == F.col("prediction"), 0.0).otherwise(1.0)
    first = F.split_part("label", F.lit(","), F.lit(1)) == F.split_part("prediction", F.lit(","), F.lit(1))
    per_label = predicted.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(wrong).alias("wrong"),
        F.sum(F.when(first, 0.0).otherwise(1.0)).alias("wrong_top"),
    )
    overall = per_label.agg(
        F.sum("n").alias("n"), F.sum("wrong").alias("wrong"), F.sum("wrong_top").alias("wrong_top")
    )

    def rows(df: DataFrame, level: str, label: Column, wrong_col: str) -> DataFrame:
        return df.select(
            F.lit(level).alias("level"), label.alias("label"), "n", (F.col(wrong_col) / F.col("n")).alias("error_rate")
        )

    return (
        rows(overall, "all", F.lit(""), "wrong")
        .unionByName(rows(overall, "top", F.lit(""), "wrong_top"))
        .unionByName(rows(per_label, "label", F.col("label"), "wrong"))
    )
