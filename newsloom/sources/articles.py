"""Raw articles, keyword sheets and the segmented form of articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.clean import html_paragraphs, strip_html
from newsloom.functions.terms import text_lines, tokens
from newsloom.plans.staging import broadcast_if_small, stage


def read_articles(
    raw: DataFrame,
    *,
    resource_type: int | None = 2,
    id_range: tuple[int, int] | None = None,
    limit: int | None = None,
    base64_body: bool = True,
) -> DataFrame:
    """(id, title, content, keywords, category) of the raw article table.

    Keeps rows of one resource type that have an id and keywords. ``id_range``
    bounds are exclusive; ``limit`` keeps the smallest ids.
    """
    rows = raw.where(
        F.col("fid").isNotNull() & F.col("fkeywords").isNotNull() & (F.col("fkeywords") != "")
    )
    if resource_type is not None:
        rows = rows.where(F.col("fresource_type") == resource_type)
    if id_range is not None:
        low, high = id_range
        rows = rows.where((F.col("fid") > low) & (F.col("fid") < high))
    body = F.unbase64("fcontent").cast("string") if base64_body else F.col("fcontent")
    articles = rows.select(
        F.col("fid").cast("long").alias("id"),
        F.col("ftitle").alias("title"),
        body.alias("content"),
        F.split("fkeywords", ",").alias("keywords"),
        F.col("fcategory").alias("category"),
    )
    return articles if limit is None else articles.orderBy("id").limit(limit)


def read_keyword_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Delimited four-column export (keyword, title, url, article), markup removed."""
    columns = ["keyword", "title", "url", "article"]
    sheet = spark.read.csv(
        path,
        schema=", ".join(f"{c} string" for c in columns),
        header=False,
        multiLine=True,
        quote='"',
        escape='"',
    )
    return sheet.select(*(strip_html(F.col(c), single_line=True).alias(c) for c in columns))


def one_row_per_id(articles: DataFrame) -> DataFrame:
    """Smallest (title, content) of each id.

    The repeated ids are found first, from the ids alone, so that only their texts are shuffled, with a
    map-side minimum; an article whose id stands once stays where it is read. Should the repeated ids
    themselves be too many to be broadcast, Spark joins them by a shuffle.
    """
    repeated = stage(articles.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again")))
    if repeated.isEmpty():
        return articles
    known, same = broadcast_if_small(repeated), F.col("id").eqNullSafe(F.col("again"))
    rest = [c for c in articles.columns if c not in ("id", "title", "content")]
    first = F.min(F.struct("title", "content", *rest)).alias("first")
    chosen = articles.join(known, same, "left_semi").groupBy("id").agg(first).select("id", "first.*")
    return articles.join(known, same, "left_anti").unionByName(chosen.select(*articles.columns))


def segment_articles(
    articles: DataFrame,
    *,
    tokenizer: Callable[[Column], Column] = tokens,
    dedup: bool = True,
) -> DataFrame:
    """Title and body as token arrays, one row per article.

    Adds ``title_words`` and ``sentences`` (one array per non-blank body line) and
    drops the text columns. ``dedup=False`` skips the search for repeated ids when they
    are known to be unique.
    """
    rows = one_row_per_id(articles) if dedup else articles
    rest = [F.col(c) for c in articles.columns if c not in ("id", "title", "content")]
    return rows.select(
        "id",
        tokenizer(F.col("title")).alias("title_words"),
        F.transform(text_lines(F.col("content")), lambda s: tokenizer(s)).alias("sentences"),
        *rest,
    )


def segment_paragraphs(
    articles: DataFrame, *, tokenizer: Callable[[Column], Column] = tokens
) -> DataFrame:
    """(id, paragraph, words): tokens of each markup paragraph of a body."""
    parts = articles.select("id", F.posexplode(html_paragraphs(F.col("content"))).alias("paragraph", "text"))
    return parts.select("id", "paragraph", tokenizer(F.col("text")).alias("words"))


def article_words(segmented: DataFrame, *extra: str) -> DataFrame:
    """(id, words): all tokens of an article in reading order."""
    words = F.flatten(F.concat(F.array("title_words"), F.col("sentences")))
    return segmented.select("id", *extra, words.alias("words"))


def to_terms(
    segmented: DataFrame,
    *,
    lexicon: DataFrame | None = None,
    nature: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Long form (id, sentence, pos, word, nature); sentence 0 is the title.

    The nature comes from a column rule or a (word, nature) lexicon; other words
    are plain nouns.
    """
    parts = F.concat(F.array("title_words"), F.col("sentences"))
    long = segmented.select("id", F.posexplode(parts).alias("sentence", "words")).select(
        "id", "sentence", F.posexplode("words").alias("pos", "word")
    )
    if lexicon is not None:
        tagged = long.join(lexicon.select("word", "nature"), "word", "left")
        return tagged.select(
            "id", "sentence", "pos", "word", F.coalesce("nature", F.lit("n")).alias("nature")
        )
    kind = nature(F.col("word")) if nature else F.lit("n")
    return long.withColumn("nature", kind)


def encode_segmented(segmented: DataFrame, nature: Callable[[Column], Column] | None = None) -> DataFrame:
    """Exchange form: ``word/nature`` terms joined by commas, lines by ``,###,``."""

    def terms(words: Column) -> Column:
        kind = nature if nature else (lambda w: F.lit("n"))
        return F.array_join(F.transform(words, lambda w: F.concat_ws("/", w, kind(w))), ",")

    return segmented.select(
        "id",
        terms(F.col("title_words")).alias("title"),
        F.array_join(F.transform("sentences", terms), ",###,").alias("content"),
    )
