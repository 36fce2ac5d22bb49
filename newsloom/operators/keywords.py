"""Keyword ranking per article: centrality, tf-idf and title blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.terms import number_to_marker
from newsloom.functions.vectors import vec_dot
from newsloom.operators.stats import top_rows
from newsloom.operators.sums import scored_by_sums
from newsloom.plans.staging import broadcast_if_small, stage


def vocabulary(vecs: DataFrame, stats: DataFrame, *, require_idf: bool = False) -> DataFrame:
    """(word, vec, idf, corpus_tf) of the words that have a vector.

    A word without statistics counts with idf 0, or leaves with ``require_idf``.
    """
    known = stats.select("word", "idf", F.col("tf").alias("corpus_tf"))
    if require_idf:
        return vecs.select("word", "vec").join(known.where(F.col("idf").isNotNull()), "word")
    return vecs.select("word", "vec").join(known, "word", "left").fillna(0, ["idf", "corpus_tf"])


def article_nouns(terms: DataFrame, words: DataFrame, min_len: int = 1) -> DataFrame:
    """(id, word, tf, in_title, first): noun occurrences of known words per article.

    Only known words are shuffled, once and by article. The result stays hashed
    by id, so the per-article steps that follow need no further exchange.
    ``first`` is the place of the first occurrence. A group here is one article,
    bounded by the text of one input row.
    """
    nouns = terms.where(F.col("nature").startswith("n") & (F.length("word") >= min_len)).select(
        "id", "sentence", "pos", number_to_marker(F.col("word")).alias("word")
    )
    known = nouns.join(words, "word", "left_semi")
    place = F.col("sentence").cast("long") * (1 << 32) + F.col("pos")
    return (
        known.select("id", "word", place.alias("place"))
        .repartition("id")
        .groupBy("id", "word")
        .agg(
            F.count(F.lit(1)).alias("tf"),
            F.max(F.when(F.col("place") < (1 << 32), 1.0).otherwise(0.0)).alias("in_title"),
            F.min("place").alias("first"),
        )
    )


def word_centrality(nouns: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds the vocabulary columns and ``sim``: the sum of cosines between a word and
    the article's other words.

    With unit vectors that sum is u·S - 1 for S the sum of the article's vectors, so
    an article costs one pass over its words and no word pairs. Rounding to nine
    decimals keeps equal sums equal, which the scaling by range relies on.

    The words of an article are counted first, and so are sorted by article without their vectors, and
    ``scored_by_sums`` leaves them in that order where the vocabulary is small enough. A word's own product is
    made once for the vocabulary, not for each article that has it.
    """
    rows = nouns.withColumn("words", F.count(F.lit(1)).over(Window.partitionBy("id")))
    vocab = vocab.withColumn("square", vec_dot(F.col("vec"), F.col("vec")))

    def score(found: DataFrame) -> DataFrame:
        sim = vec_dot(F.col("vec"), F.col("total")) - F.col("square")
        sim = F.when(F.col("words") > 1, F.round(sim, 9)).otherwise(F.lit(0.0))
        return found.withColumn("sim", sim).drop("vec", "square", "total", "words")

    return scored_by_sums(rows, vocab, score)


def minmax_scale(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Scales columns to 0..1 within a key; a zero range divides by one."""
    w = Window.partitionBy(key)
    out = {}
    for name in cols:
        low, high = F.min(name).over(w), F.max(name).over(w)
        width = F.when(high > low, high - low).otherwise(F.lit(1.0))
        out[name] = (F.col(name) - low) / width
    return df.withColumns(out)


def running_fold(values: Column) -> Column:
    """(high, low) as a single scan keeps them: each value either raises ``high`` or
    becomes ``low``; both start at zero."""
    start = F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("low"))

    def step(acc: Column, x: Column) -> Column:
        rises = acc["high"] < x
        return F.struct(
            F.when(rises, x).otherwise(acc["high"]).alias("high"),
            F.when(rises, acc["low"]).otherwise(x).alias("low"),
        )

    return F.aggregate(values, start, step)


def legacy_scale(df: DataFrame, key: str, cols: list[str], order: str) -> DataFrame:
    """Scaling by ``running_fold`` in occurrence order instead of the true range.

    The rows of a key are listed, folded and given back in one pass, so ``df`` is computed once.
    """
    rest = [c for c in df.columns if c not in (key, order, *cols)]
    listed = F.array_sort(F.collect_list(F.struct(order, *cols, *rest)))
    folded = df.where(F.col(key).isNotNull()).groupBy(key).agg(listed.alias("l")).select(
        key, "l", *(running_fold(F.col("l")[name]).alias(f"{name}_fold") for name in cols)
    )
    rows = folded.select(key, *(f"{name}_fold" for name in cols), F.inline("l"))
    out = {}
    for name in cols:
        high, low = F.col(f"{name}_fold.high"), F.col(f"{name}_fold.low")
        width = F.when(high != low, high - low).otherwise(F.lit(1.0))
        out[name] = (F.col(name) - low) / width
    return rows.withColumns(out).select(*df.columns)


def semantic_keywords(
    terms: DataFrame,
    vecs: DataFrame,
    stats: DataFrame,
    *,
    w_sim: float = 1.0,
    w_tfidf: float = 1.0,
    w_title: float = 1.0,
    k: int = 3,
    tfidf: str = "doc",
    scaling: str = "minmax",
    titles: DataFrame | None = None,
    require_idf: bool = False,
    min_len: int = 1,
) -> DataFrame:
    """(id, rank, word, score): the k best words of each article.

    ``terms`` is the long form, ``vecs`` (word, vec) with unit vectors and ``stats``
    (word, tf, idf), both staged. ``tfidf`` weighs idf by the count in the article
    (``doc``), in the corpus (``corpus``) or not at all (``idf``). With ``titles``
    (id, title) a word is in the title when the raw title contains it.
    """
    vocab = stage(vocabulary(vecs, stats, require_idf=require_idf))
    nouns = article_nouns(terms, broadcast_if_small(vocab.select("word")), min_len)
    scored = word_centrality(nouns, vocab)
    factor = {"doc": F.col("tf"), "corpus": F.col("corpus_tf"), "idf": F.lit(1.0)}[tfidf]
    scored = scored.withColumn("tfidf", F.col("idf") * factor)
    if titles is not None:
        raw = titles.select("id", F.lower("title").alias("raw_title"))
        scored = scored.join(raw, "id", "left").withColumn(
            "in_title", F.when(F.col("raw_title").contains(F.col("word")), 1.0).otherwise(0.0)
        )
    if scaling == "legacy":
        scaled = legacy_scale(scored, "id", ["sim", "tfidf"], "first")
    else:
        scaled = minmax_scale(scored, "id", ["sim", "tfidf"])
    score = w_sim * F.col("sim") + w_tfidf * F.col("tfidf") + w_title * F.col("in_title")
    ranked = scaled.select("id", "word", F.round(score, 6).alias("score"))
    return top_rows(ranked, ["id"], [F.desc("score"), F.asc("word")], k).select(
        "id", "rank", "word", "score"
    )


def keyword_lists(ranked: DataFrame) -> DataFrame:
    """(id, kw): ranked (word, score) pairs of each article."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "word", "score")))
    pairs = F.transform(listed, lambda r: F.struct(r["word"].alias("word"), r["score"].alias("score")))
    return ranked.groupBy("id").agg(pairs.alias("kw"))
