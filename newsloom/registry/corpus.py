"""The driver tables seen as the inputs of the operators, in Spark and in SQL.

An article is a document: its first line, however long, is its title, the rest its body. Queries
of bodies and of title marks take it with ``headline``: a first line longer than that is no title
but a part of the body, so that no body loses a paragraph to its title.
A word vector is an embedding given to the most frequent non-stop word of its hash bucket.
A doc vector is the embedding whose id is the article's id modulo the number of embeddings,
with the article's ten most frequent words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.terms import word_counts
from newsloom.functions.vectors import as_doubles, vec_unit
from newsloom.operators.category import doc_keyword_vector
from newsloom.operators.stats import best_words, doc_tf, tfidf_stats
from newsloom.plans.staging import dealt, stage
from newsloom.sources.articles import article_words, segment_articles

#: Longest first line that is a title where bodies are kept whole.
HEADLINE = 200


def shown(value, decimals: int):
    """Decimals of a value that was rounded before, by plain double arithmetic."""
    scale = 10.0**decimals
    return F.floor(value * scale + 0.5) / scale


def shown_sql(value: str, decimals: int) -> str:
    scale = f"1{'0' * decimals}::DOUBLE"
    return f"floor({value} * {scale} + 0.5::DOUBLE) / {scale}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))


def articles(spark: SparkSession, sf: str, headline: int | None = None) -> DataFrame:
    line = F.substring_index("text", "\n", 1)
    title, content = line, F.substring("text", F.length(line) + 2, F.length("text"))
    if headline is not None:
        headed = F.length(line) <= headline
        title = F.when(headed, title).otherwise(F.lit(""))
        content = F.when(headed, content).otherwise(F.col("text"))
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"),
        title.alias("title"),
        content.alias("content"),
        F.concat_ws(",", "lang", "source").alias("category"),
    )


def segmented(spark: SparkSession, sf: str, headline: int | None = None) -> DataFrame:
    # doc_id is the key of documents, so no text has to be shuffled to deduplicate.
    return segment_articles(articles(spark, sf, headline), dedup=False)


def stats(spark: SparkSession, sf: str) -> DataFrame:
    """Word statistics, staged: every ranking job reads them more than once."""
    return stage(tfidf_stats(segmented(spark, sf)))


def word_vectors(spark: SparkSession, sf: str, word_stats: DataFrame) -> DataFrame:
    """(word, vec) with unit vectors, staged."""
    embeddings = table(spark, sf, "embeddings")
    buckets = embeddings.agg(F.count(F.lit(1))).scalar()
    code = F.conv(F.substring(F.md5(F.encode("word", "utf-8")), 1, 8), 16, 10).cast("long")
    candidates = word_stats.where(
        (F.length("word") > 1) & (F.col("idf") > 3) & ~F.col("word").rlike("^[0-9]+$")
    ).select("word", "tf", (code % buckets).alias("vec_id"))
    picked = candidates.groupBy("vec_id").agg(
        F.min(F.struct((-F.col("tf")).alias("t"), "word"))["word"].alias("word")
    )
    return stage(
        picked.join(embeddings, "vec_id").select("word", vec_unit(F.col("embedding")).alias("vec"))
    )


def counted_articles(spark: SparkSession, sf: str) -> DataFrame:
    """(id, counts, words): word counts of each article, and its ten most frequent
    words of more than one character as (word, weight 1.0)."""
    seg = article_words(segmented(spark, sf))
    counted = seg.select("id", word_counts(F.col("words")).alias("counts"))
    long = F.filter("counts", lambda c: F.length(c["word"]) > 1)
    ranked = F.sort_array(F.transform(long, lambda c: F.struct((-c["n"]).alias("n"), c["word"].alias("word"))))
    words = F.transform(
        F.slice(ranked, 1, 10), lambda r: F.struct(r["word"].alias("word"), F.lit(1.0).alias("weight"))
    )
    return counted.withColumn("words", words)


def docvecs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, words, vec): every article with its words and an embedding."""
    embeddings = table(spark, sf, "embeddings")
    words = counted_articles(spark, sf).select("id", "words", (F.col("id") % embeddings.count()).alias("vec_id"))
    vectors = embeddings.select("vec_id", as_doubles(F.col("embedding")).alias("vec"))
    return words.join(vectors, "vec_id").select("id", "words", "vec")


def article_items(spark: SparkSession, sf: str) -> DataFrame:
    """(id, words, vec) of every article: the sum of its known words' vectors, weighted
    by their counts, and its ten most frequent words. Articles without a known word
    have no vector and are left out. Texts are cut into words once for both."""
    vecs = word_vectors(spark, sf, stats(spark, sf))
    counted = stage(counted_articles(spark, sf))
    weighted = counted.select("id", F.explode("counts").alias("c")).select("id", "c.word", F.col("c.n").alias("weight"))
    return doc_keyword_vector(weighted, vecs).join(counted.select("id", "words"), "id").select("id", "words", "vec")


def publisher_keywords(spark: SparkSession, sf: str, word_stats: DataFrame, k: int = 5) -> DataFrame:
    """(id, cate, word): the k words of an article with the highest tf * idf."""
    known = word_stats.where((F.length("word") > 1) & (F.col("df") >= 2)).select("word", "df", "idf")
    counted = doc_tf(segmented(spark, sf), "category").where(F.length("word") > 1).drop("rel_tf")
    return best_words(counted, known, k).select("id", F.col("category").alias("cate"), "word")


ARTICLES = """
articles AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title,
         substr(text, length(split_part(text, chr(10), 1)) + 2) AS content,
         lang || ',' || source AS category
  FROM documents)"""

BODY_ARTICLES = f"""
articles AS (
  SELECT doc_id AS id,
         CASE WHEN length(split_part(text, chr(10), 1)) <= {HEADLINE}
              THEN split_part(text, chr(10), 1) ELSE '' END AS title,
         CASE WHEN length(split_part(text, chr(10), 1)) <= {HEADLINE}
              THEN substr(text, length(split_part(text, chr(10), 1)) + 2) ELSE text END AS content,
         lang || ',' || source AS category
  FROM documents)"""


def with_bodies(sql: str) -> str:
    """SQL whose articles keep long first lines in their bodies, as ``articles`` does with ``HEADLINE``."""
    return sql.replace(ARTICLES, BODY_ARTICLES)


def with_titles(sql: str) -> str:
    return sql.replace(BODY_ARTICLES, ARTICLES)


TOKENS = ARTICLES + r""",
parts AS (
  SELECT id, [title] || list_filter(string_split(content, chr(10)), lambda s: trim(s) <> '') AS lines
  FROM articles),
sents AS (
  SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS sentence FROM parts),
sent_words AS (
  SELECT id, sentence, regexp_extract_all(lower(line), '[\p{L}\p{N}]+') AS ws FROM sents),
tokens AS (
  SELECT id, sentence, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM sent_words)"""

STATS = TOKENS + """,
stats AS MATERIALIZED (
  SELECT word, count(*) AS tf, count(DISTINCT id) AS df,
         ln((SELECT count(*) FROM articles)::DOUBLE / count(DISTINCT id)) AS idf
  FROM tokens GROUP BY word)"""

VECTORS = STATS + r""",
buckets AS (
  SELECT word, tf, ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id
  FROM stats WHERE length(word) > 1 AND idf > 3 AND NOT regexp_full_match(word, '[0-9]+')),
picked AS (
  SELECT word, embedding::DOUBLE[] AS raw
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY tf DESC, word) AS rn FROM buckets)
  JOIN embeddings USING (vec_id) WHERE rn = 1),
wordvecs AS MATERIALIZED (
  SELECT word, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS vec FROM picked)"""

DOC_TF = """
doc_tf AS MATERIALIZED (
  SELECT id, word, count(*) AS tf FROM tokens GROUP BY id, word)"""

DOCVECS = TOKENS + "," + DOC_TF + """,
doc_top AS (
  SELECT id, word FROM (
    SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY tf DESC, word) AS rn
    FROM doc_tf WHERE length(word) > 1) WHERE rn <= 10),
docvecs AS (
  SELECT id, embedding::DOUBLE[] AS vec
  FROM articles JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings))"""

PUBLISHER = DOC_TF + """,
publisher AS MATERIALIZED (
  SELECT r.id, a.category AS cate, r.word FROM (
    SELECT id, word, row_number() OVER (
             PARTITION BY id ORDER BY round(d.tf * s.idf, 6) DESC, word) AS rn
    FROM doc_tf d JOIN stats s USING (word) WHERE length(word) > 1 AND s.df >= 2) r
  JOIN articles a ON a.id = r.id WHERE rn <= 5)"""

ITEMS = DOC_TF + """,
item_parts AS (
  SELECT id, generate_subscripts(vec, 1) AS pos, unnest(list_transform(vec, lambda x: x * tf)) AS x
  FROM doc_tf JOIN wordvecs USING (word)),
item_sums AS (SELECT id, pos, sum(x) AS x FROM item_parts GROUP BY id, pos),
item_vecs AS (SELECT id, list(x ORDER BY pos) AS raw FROM item_sums GROUP BY id),
item_words AS (
  SELECT id, list(word) AS words FROM (
    SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY tf DESC, word) AS rn
    FROM doc_tf WHERE length(word) > 1) WHERE rn <= 10 GROUP BY id),
items AS MATERIALIZED (
  SELECT id, words, raw, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS vec
  FROM item_vecs JOIN item_words USING (id))"""
