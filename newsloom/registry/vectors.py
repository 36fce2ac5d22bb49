"""Vector arithmetic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import vectors as v
from newsloom.operators.similarity import doc_pair_similarity
from newsloom.operators.weights import merge_pair, merge_word_weights
from newsloom.registry import corpus as c
from newsloom.registry import query
from newsloom.registry.tables import _SIGNATURE_SQL, signature


@query(
    "vec_norm_unit",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
        u AS (SELECT vec_id, norm, list_transform(v, lambda x: x / norm) AS vec FROM n)
        SELECT vec_id, round(norm, 6) AS norm, {_SIGNATURE_SQL} AS signature,
               round(list_dot_product(vec, vec), 6) AS unit_square FROM u""",
)
def vec_norm_unit(spark, sf):
    e = c.table(spark, sf, "embeddings").select(
        "vec_id", F.round(v.vec_norm(F.col("embedding")), 6).alias("norm"),
        v.vec_unit(F.col("embedding")).alias("vec"),
    )
    return e.select(
        "vec_id", "norm", signature(F.col("vec")).alias("signature"),
        F.round(v.vec_dot(F.col("vec"), F.col("vec")), 6).alias("unit_square"),
    )


@query(
    "doc_pair_similarity",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
       p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_dot_product(a.v, b.v) AS d,
                    sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) AS s
             FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
       SELECT id_a, id_b, round(d / s, 6) + 0.0 AS sim, round(d, 6) + 0.0 AS dot,
              round(1 / (1 + exp(-greatest(-6, least(6, 20 * d)))), 6) AS squashed FROM p""",
)
def doc_pairs(spark, sf):
    docs = c.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )
    pairs = docs.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    sims = doc_pair_similarity(docs, pairs)
    return sims.select(
        "id_a", "id_b", (F.round("sim", 6) + 0.0).alias("sim"), (F.round("dot", 6) + 0.0).alias("dot"),
        F.round(v.sigmoid(20 * F.col("dot")), 6).alias("squashed"),
    )


@query(
    "vec_sum_by_label",
    """WITH e AS (SELECT label, quality_weight AS w, unnest(embedding::DOUBLE[]) AS x,
                         generate_subscripts(embedding, 1) AS pos
                  FROM (SELECT *, 1 + vec_id % 3 AS quality_weight FROM embeddings))
       SELECT label, pos, round(sum(x), 5) + 0.0 AS total, round(sum(x * w), 5) + 0.0 AS weighted,
              round(sum(x * w) / sum(w), 5) + 0.0 AS mean FROM e GROUP BY label, pos""",
)
def vec_sum_by_label(spark, sf):
    e = c.table(spark, sf, "embeddings").withColumn("w", 1 + F.col("vec_id") % 3)
    sums = e.groupBy("label").agg(
        v.vec_sum(F.col("embedding")).alias("total"),
        v.vec_sum(F.col("embedding"), F.col("w")).alias("weighted"),
        F.sum("w").alias("w"),
    )
    zipped = sums.select("label", "w", F.posexplode(F.arrays_zip("total", "weighted")).alias("pos", "x"))

    def r5(x):
        return F.round(x, 5) + 0.0

    return zipped.select(
        "label", (F.col("pos") + 1).cast("long").alias("pos"), r5(F.col("x.total")).alias("total"),
        r5(F.col("x.weighted")).alias("weighted"), r5(F.col("x.weighted") / F.col("w")).alias("mean"),
    )


@query(
    "merge_word_weights",
    f"""WITH {c.DOCVECS}, w AS (
          SELECT lang AS label, word, count(*)::DOUBLE AS weight
          FROM documents JOIN doc_top ON doc_top.id = doc_id WHERE lang IS NOT NULL GROUP BY lang, word),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, word) AS rank FROM w)
        SELECT label, rank::INT AS rank, word, weight FROM r WHERE rank <= 15""",
)
def merge_weights(spark, sf):
    labels = c.table(spark, sf, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    items = c.docvecs(spark, sf).join(labels, "id")
    merged = merge_word_weights(items, "label", 15)
    return merged.select("label", F.posexplode("words").alias("rank", "w")).select(
        "label", (F.col("rank") + 1).alias("rank"), "w.word", "w.weight"
    )


@query(
    "merge_word_weights_pairwise",
    f"""WITH {c.DOCVECS}, pooled AS (
          SELECT id, word FROM doc_top
          UNION ALL SELECT id - 1, word FROM doc_top WHERE id - 1 IN (SELECT id FROM articles)),
        s AS (SELECT id, word, count(*) AS n FROM pooled GROUP BY id, word),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, word) AS rn FROM s)
        SELECT id, string_agg(word || ':' || n, ',' ORDER BY rn) AS words FROM r WHERE rn <= 12
          AND id + 1 IN (SELECT id FROM articles) GROUP BY id""",
)
def merge_weights_pairwise(spark, sf):
    docs = c.docvecs(spark, sf).select("id", "words")
    after = docs.select((F.col("id") - 1).alias("id"), F.col("words").alias("next"))
    merged = docs.join(after, "id").select("id", merge_pair(F.col("words"), F.col("next"), 12).alias("m"))
    text = F.transform("m", lambda p: F.concat_ws(":", p["word"], p["weight"].cast("long").cast("string")))
    return merged.where(F.size("m") > 0).select("id", F.array_join(text, ",").alias("words"))
