"""Category model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.operators import category as op
from newsloom.operators import stats as st
from newsloom.operators.keywords import semantic_keywords
from newsloom.plans.staging import shared_dir, stage
from newsloom.registry import corpus as c
from newsloom.registry import query
from newsloom.registry.keywords import NOUNS, blend_sql
from newsloom.registry.tables import signature
from newsloom.sources.articles import to_terms

RANKED = NOUNS + "," + blend_sql().rsplit("SELECT id, rank", 1)[0] + """,
ranked_kw AS MATERIALIZED (
  SELECT r.id, a.category AS cate, r.word FROM ranked r JOIN articles a ON a.id = r.id WHERE rank <= 3)"""
PUBLISHED = c.STATS + "," + c.PUBLISHER


def ranked_keywords(spark, sf, stats, vecs, headline=c.HEADLINE):
    """The engine's own top-3 keywords joined to the articles' categories."""
    ranked = semantic_keywords(to_terms(c.segmented(spark, sf, headline)), vecs, stats)
    cates = c.articles(spark, sf).select("id", F.col("category").alias("cate"))
    return ranked.select("id", "word").join(cates, "id").select("id", "cate", "word")


def inputs(spark, sf):
    stats = c.stats(spark, sf)
    vecs = c.word_vectors(spark, sf, stats)
    return stats, vecs


@query(
    "keywords_by_category_source",
    f"""WITH {RANKED}, {c.PUBLISHER}
        SELECT 'ranked' AS source, id, cate, word FROM ranked_kw
        UNION ALL SELECT 'publisher', id, cate, word FROM publisher""",
)
def keywords_by_category_source(spark, sf):
    stats, vecs = inputs(spark, sf)
    own = ranked_keywords(spark, sf, stats, vecs).withColumn("source", F.lit("ranked"))
    given = c.publisher_keywords(spark, sf, stats).withColumn("source", F.lit("publisher"))
    return own.unionByName(given).select("source", "id", "cate", "word")


@query(
    "category_keywords",
    f"""WITH {PUBLISHED}, n AS (SELECT cate, word, count(*) AS n FROM publisher GROUP BY cate, word)
        SELECT cate, word, n, rank FROM (
          SELECT *, (row_number() OVER (PARTITION BY cate ORDER BY n DESC, word))::INT AS rank FROM n)
        WHERE rank <= 20""",
)
def category_keywords(spark, sf):
    return st.category_keyword_histogram(c.publisher_keywords(spark, sf, c.stats(spark, sf)), top_n=20)


@query(
    "category_profile",
    f"""WITH {PUBLISHED}, n AS (SELECT cate, word, count(*) AS n FROM publisher GROUP BY cate, word),
        r AS (SELECT *, row_number() OVER (PARTITION BY cate ORDER BY n DESC, word) AS rank FROM n),
        top AS (SELECT cate, count(*) AS reprekeysize, string_agg(word || ':' || n, ',' ORDER BY rank) AS reprekeys
                FROM r WHERE rank <= 100 GROUP BY cate),
        k AS (SELECT cate, count(*) AS keysize FROM n GROUP BY cate),
        a AS (SELECT cate, count(DISTINCT id) AS artsize FROM publisher GROUP BY cate)
        SELECT cate, artsize, keysize, reprekeysize, reprekeys FROM a JOIN k USING (cate) JOIN top USING (cate)""",
)
def category_profile(spark, sf):
    return st.category_profile(c.publisher_keywords(spark, sf, c.stats(spark, sf)), top_n=100)


@query(
    "keyword_summary",
    f"""WITH {PUBLISHED}, n AS (SELECT word, count(*) AS n FROM publisher GROUP BY word)
        SELECT (SELECT count(DISTINCT cate) FROM publisher) AS categories, count(*) AS keywords,
               count(CASE WHEN n > 5 THEN 1 END) AS over_5, count(CASE WHEN n > 10 THEN 1 END) AS over_10,
               count(CASE WHEN n > 100 THEN 1 END) AS over_100 FROM n""",
)
def keyword_summary(spark, sf):
    keywords = c.publisher_keywords(spark, sf, c.stats(spark, sf))
    return st.keyword_frequency_summary(keywords, limits=(5, 10, 100))


@query(
    "missing_vocabulary",
    f"""WITH {c.VECTORS}, {c.PUBLISHER}
        SELECT DISTINCT word FROM publisher WHERE word NOT IN (SELECT word FROM wordvecs)""",
)
def missing_vocabulary(spark, sf):
    stats, vecs = inputs(spark, sf)
    return op.missing_vocabulary(c.publisher_keywords(spark, sf, stats), vecs)


# The split hash of train_test_split.
_TRAIN = "('0x' || substr(md5('11:' || id), 1, 8))::BIGINT::DOUBLE < 0.9::DOUBLE * 4294967296"
MODEL = RANKED + f""",
hist AS (
  SELECT cate, word, n FROM (
    SELECT cate, word, n, row_number() OVER (PARTITION BY cate ORDER BY n DESC, word) AS rn
    FROM (SELECT cate, word, count(*) AS n FROM ranked_kw WHERE {_TRAIN} GROUP BY cate, word)) WHERE rn <= 20),
cate_parts AS (
  SELECT cate, n, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM hist JOIN wordvecs USING (word)),
cate_totals AS (SELECT cate, sum(n)::DOUBLE AS total FROM hist GROUP BY cate),
cate_sums AS (
  SELECT cate, pos, sum(x * n) / any_value(total) AS x, sum(x) AS plain
  FROM cate_parts JOIN cate_totals USING (cate) GROUP BY cate, pos),
centroids AS MATERIALIZED (
  SELECT cate, list(x ORDER BY pos) AS vec, list(plain ORDER BY pos) AS plain FROM cate_sums GROUP BY cate)"""


@query(
    "category_centroids",
    f"""WITH {MODEL} SELECT cate,
          round(list_sum(list_transform(vec, lambda x, i: x * i)), 5) + 0.0 AS mean_signature,
          round(list_sum(list_transform(plain, lambda x, i: x * i)), 5) + 0.0 AS sum_signature
        FROM centroids""",
)
def category_centroids(spark, sf):
    stats, vecs = inputs(spark, sf)
    train, _ = op.train_test_split(ranked_keywords(spark, sf, stats, vecs), "id")
    hist = stage(st.category_keyword_histogram(train, top_n=20))
    means = op.category_centroids(hist, vecs).select("cate", signature(F.col("vec")).alias("mean_signature"))
    sums = op.category_centroids(hist, vecs, weighted=False)
    return means.join(sums.select("cate", signature(F.col("vec")).alias("sum_signature")), "cate")


PREDICTED = MODEL + f""",
doc_parts AS (
  SELECT id, cate, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x
  FROM ranked_kw JOIN wordvecs USING (word) WHERE NOT ({_TRAIN})),
doc_sums AS (SELECT id, cate, pos, sum(x) AS x FROM doc_parts GROUP BY id, cate, pos),
doc_vecs AS (SELECT id, cate, list(x ORDER BY pos) AS vec FROM doc_sums GROUP BY id, cate),
cosines AS (
  SELECT d.id, d.cate AS label, c.cate AS prediction, round(list_dot_product(d.vec, c.vec)
         / (sqrt(list_dot_product(d.vec, d.vec)) * sqrt(list_dot_product(c.vec, c.vec))), 9) AS sim
  FROM doc_vecs d, centroids c),
predicted AS (
  SELECT id, label, CASE WHEN sim > 0 THEN prediction ELSE '' END AS prediction,
         CASE WHEN sim > 0 THEN sim ELSE 0 END AS sim
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, prediction) AS rn FROM cosines)
  WHERE rn = 1)"""


def fitted(spark, sf):
    """Centroids of the training articles and predictions for the held-out ones."""
    stats, vecs = inputs(spark, sf)
    keywords = stage(ranked_keywords(spark, sf, stats, vecs))
    train, test = op.train_test_split(keywords, "id")
    centroids = stage(op.category_centroids(st.category_keyword_histogram(train, top_n=20), vecs))
    docs = stage(op.doc_keyword_vector(test, vecs))
    predicted = op.nearest_centroid(docs, centroids)
    labels = test.select("id", F.col("cate").alias("label")).distinct()
    return centroids, predicted.join(labels, "id").select("id", "label", "prediction", "sim")


@query("nearest_centroid", f"WITH {PREDICTED} SELECT id, label, prediction, {c.shown_sql('sim', 6)} AS sim FROM predicted")
def nearest_centroid(spark, sf):
    return fitted(spark, sf)[1].withColumn("sim", c.shown(F.col("sim"), 6))


ERRORS = """
SELECT 'all' AS level, '' AS label, count(*) AS n,
       round(avg(CASE WHEN label = prediction THEN 0 ELSE 1 END), 8) AS error_rate FROM {t}
UNION ALL SELECT 'top', '', count(*),
       round(avg(CASE WHEN split_part(label, ',', 1) = split_part(prediction, ',', 1) THEN 0 ELSE 1 END), 8) FROM {t}
UNION ALL SELECT 'label', label, count(*),
       round(avg(CASE WHEN label = prediction THEN 0 ELSE 1 END), 8) FROM {t} GROUP BY label"""


@query("nearest_centroid_error", f"WITH {PREDICTED} {ERRORS.format(t='predicted')}")
def nearest_centroid_error(spark, sf):
    return st.error_rates(fitted(spark, sf)[1]).withColumn("error_rate", F.round("error_rate", 8))


@query(
    "embedding_label_centroids",
    f"""WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
       s AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY label, pos),
       cents AS (SELECT label::VARCHAR AS cate, list(x ORDER BY pos) AS vec FROM s GROUP BY label),
       cosines AS (SELECT vec_id AS id, e.label::VARCHAR AS label, c.cate AS prediction,
           round(list_dot_product(embedding::DOUBLE[], c.vec)
             / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c.vec, c.vec))), 9) AS sim
         FROM embeddings e, cents c),
       b AS (SELECT id, label, prediction, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, prediction) AS rn FROM cosines) WHERE rn = 1)
       SELECT id, label, CASE WHEN sim > 0 THEN prediction ELSE '' END AS prediction,
              {c.shown_sql('CASE WHEN sim > 0 THEN sim ELSE 0 END', 6)} AS sim FROM b""",
)
def embedding_label_centroids(spark, sf):
    from newsloom.functions.vectors import vec_sum

    e = c.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    centroids = e.groupBy(F.col("label").alias("cate")).agg(vec_sum(F.col("vec")).alias("vec"))
    predicted = op.nearest_centroid(e.select("id", "vec"), centroids)
    return predicted.join(e.select("id", "label"), "id").select(
        "id", "label", "prediction", c.shown(F.col("sim"), 6).alias("sim")
    )


@query(
    "publish_if",
    f"""WITH {MODEL} SELECT cate, round(sqrt(list_dot_product(vec, vec)), 6) AS norm FROM centroids""",
)
def publish_if(spark, sf):
    """A gate no error passes, then one every error passes: those centroids are read back."""
    from newsloom.functions.vectors import vec_norm

    centroids, predicted = fitted(spark, sf)
    predicted = stage(predicted)
    path = f"{shared_dir(spark)}/newsloom/centroids-{uuid.uuid4().hex}"
    op.publish_if(centroids, predicted, path + "-no", max_error=0.0)
    op.publish_if(centroids, predicted, path, max_error=1.01)
    published = spark.read.schema(centroids.schema).parquet(path)
    return published.select("cate", F.round(vec_norm(F.col("vec")), 6).alias("norm"))


@query(
    "train_test_split",
    f"""SELECT doc_id, {_TRAIN.replace('id)', 'doc_id)')} AS in_train FROM documents""",
)
def train_test_split(spark, sf):
    train, test = op.train_test_split(c.table(spark, sf, "documents").select("doc_id"), "doc_id")
    return train.withColumn("in_train", F.lit(True)).unionByName(test.withColumn("in_train", F.lit(False)))
