"""Word expansion and document similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.terms import is_vocabulary_nature
from newsloom.functions.vectors import as_doubles, vec_unit
from newsloom.operators import cooccurrence as co
from newsloom.operators import neighbours as nb
from newsloom.operators import similarity as sim
from newsloom.operators.stats import corpus_word_count
from newsloom.registry import corpus as c
from newsloom.registry import query
from newsloom.registry.stats import _NATURE_SQL, nature_rule

_PAIRS_SQL = """sims AS (
  SELECT a.word AS word, b.word AS neighbour, round(list_dot_product(a.vec, b.vec), 6) + 0.0 AS score
  FROM wordvecs a JOIN wordvecs b ON a.word <> b.word)"""


def neighbour_sql(k, where):
    return f"""WITH {c.VECTORS}, {_PAIRS_SQL}
        SELECT word, rank, neighbour, score FROM (
          SELECT *, (row_number() OVER (PARTITION BY word ORDER BY score DESC, neighbour))::INT AS rank
          FROM sims WHERE {where}) WHERE rank <= {k}"""


@query("word_neighbours", neighbour_sql(24, "score > 0.1"))
def word_neighbours(spark, sf):
    stats = c.stats(spark, sf)
    return nb.word_neighbours(c.word_vectors(spark, sf, stats), k=24, threshold=0.1)


@query("word_neighbours_non_negative", neighbour_sql(10, "score >= 0"))
def word_neighbours_non_negative(spark, sf):
    stats = c.stats(spark, sf)
    return nb.word_neighbours(c.word_vectors(spark, sf, stats), k=10, threshold=0.0, inclusive=True)


@query("pair_similarity", neighbour_sql(10, "true"))
def pair_similarity(spark, sf):
    stats = c.stats(spark, sf)
    return nb.pair_similarity(c.word_vectors(spark, sf, stats), k=10)


COOCCUR = c.with_bodies(c.TOKENS) + f""",
kept AS (
  SELECT id, sentence, word, row_number() OVER (PARTITION BY id, sentence ORDER BY pos) AS p
  FROM (SELECT *, {_NATURE_SQL} AS nature FROM tokens)
  WHERE sentence > 0 AND ((nature LIKE 'n%' AND nature NOT LIKE 'nx%') OR nature LIKE 'mz%' OR nature = 'mbk')),
pairs AS MATERIALIZED (
  SELECT least(x.word, y.word) AS a, greatest(x.word, y.word) AS b, count(*) AS n
  FROM kept x JOIN (SELECT unnest([1, 2, 3, 4]) AS d) ON true
  JOIN kept y ON y.id = x.id AND y.sentence = x.sentence AND y.p = x.p + d
  WHERE x.word <> y.word GROUP BY 1, 2),
sides AS (SELECT a AS word, b AS partner, n FROM pairs UNION ALL SELECT b, a, n FROM pairs),
wtf AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS tf FROM sides GROUP BY word)"""


def paragraphs(spark, sf):
    """Body lines with the words whose nature counts as vocabulary."""
    lines = c.segmented(spark, sf, c.HEADLINE).select("id", F.explode("sentences").alias("words"))
    kept = F.filter("words", lambda w: is_vocabulary_nature(nature_rule(w)))
    return lines.select("id", kept.alias("words"))


@query("cooccurrence_pairs", f"WITH {COOCCUR} SELECT a, b, n FROM pairs")
def cooccurrence_pairs(spark, sf):
    return co.cooccurrence_pairs(paragraphs(spark, sf))


@query(
    "window_tf",
    f"""WITH {COOCCUR}, v AS (SELECT DISTINCT word FROM kept)
        SELECT word, coalesce(tf, 0) AS tf FROM v LEFT JOIN wtf USING (word)""",
)
def window_tf(spark, sf):
    lines = paragraphs(spark, sf)
    vocabulary = lines.select(F.explode("words").alias("word")).distinct()
    return co.window_tf(co.cooccurrence_pairs(lines), vocabulary)


@query(
    "cooccurrence_expansion",
    f"""WITH {COOCCUR}, v AS (SELECT DISTINCT word FROM kept),
        scored AS (SELECT s.word, s.partner, n::DOUBLE / (x.tf::DOUBLE * y.tf::DOUBLE) AS score
          FROM sides s JOIN wtf x ON x.word = s.word JOIN wtf y ON y.word = s.partner),
        best AS (SELECT word, string_agg(partner, ',' ORDER BY rank) AS partners, max(score) AS top, count(*) AS n
          FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, partner) AS rank FROM scored)
          WHERE rank <= 20 GROUP BY word)
        SELECT word, coalesce(partners, '') AS partners, round(coalesce(top, 0), 9) AS top,
               coalesce(n, 0)::INT AS n
        FROM v LEFT JOIN best USING (word)""",
)
def cooccurrence_expansion(spark, sf):
    lines = paragraphs(spark, sf)
    vocabulary = lines.select(F.explode("words").alias("word")).distinct()
    lists = co.expansion_lists(co.cooccurrence_expansion(co.cooccurrence_pairs(lines)), vocabulary)
    return lists.select(
        "word", F.array_join(F.col("partners")["word"], ",").alias("partners"),
        F.round(F.coalesce(F.get(F.col("partners")["score"], 0), F.lit(0.0)), 9).alias("top"),
        F.size("partners").alias("n"),
    )


_E_SQL = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
  u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vec FROM e)"""


def docs(spark, sf):
    return c.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), as_doubles(F.col("embedding")).alias("vec")
    )


@query(
    "similar_documents",
    f"""WITH {_E_SQL} SELECT u.id, round(list_dot_product(u.vec, q.vec), 6) AS sim
        FROM u, (SELECT vec FROM u WHERE id = 7) q
        WHERE list_dot_product(u.vec, q.vec) > 0.15 ORDER BY id LIMIT 50""",
)
def similar_documents(spark, sf):
    found = sim.similar_documents(docs(spark, sf), 7, threshold=0.15, limit=50)
    return found.select("id", F.round("sim", 6).alias("sim"))


@query(
    "low_similarity_pairs",
    f"""WITH {_E_SQL}, s AS (SELECT u.id, u.vec FROM u, (SELECT vec FROM u WHERE id = 7) q
          WHERE list_dot_product(u.vec, q.vec) > 0.15),
        p AS (SELECT a.id, b.id AS other, round(list_dot_product(a.vec, b.vec), 6) + 0.0 AS sim
          FROM s a JOIN s b ON a.id <> b.id WHERE round(list_dot_product(a.vec, b.vec), 6) <= 0.8)
        SELECT id, rank, other, sim FROM (
          SELECT *, (row_number() OVER (PARTITION BY id ORDER BY sim, other))::INT AS rank FROM p) WHERE rank <= 5""",
)
def low_similarity_pairs(spark, sf):
    """The five least similar others of every document found similar to one document."""
    found = sim.similar_documents(docs(spark, sf), 7, threshold=0.15)
    return sim.lowest_similarities(found, k=5, flag_below=0.8)


@query(
    "low_similarity",
    f"""WITH {_E_SQL}, s AS (SELECT a.id, b.id AS other, round(list_dot_product(a.vec, b.vec), 6) AS sim
          FROM u a JOIN u b ON a.id <> b.id)
        SELECT id, count(CASE WHEN sim <= 0.05 THEN 1 END) AS n_low, min(sim) AS lowest,
               round(count(CASE WHEN sim <= 0.05 THEN 1 END) / count(*), 6) AS low_share,
               arg_min(other, (sim, other)) AS lowest_id FROM s GROUP BY id""",
)
def low_similarity(spark, sf):
    units = docs(spark, sf).select("id", vec_unit(F.col("vec")).alias("vec"))
    return nb.low_similarity(units, flag_below=0.05).withColumn("low_share", F.round("low_share", 6))


@query(
    "shared_words_rank",
    f"""WITH {c.TOKENS}, {c.DOC_TF}, {'doc_top' + c.DOCVECS.split('doc_top', 1)[1]},
        wanted AS (SELECT word FROM tokens GROUP BY word ORDER BY count(*) DESC, word LIMIT 40),
        d AS (SELECT id, list(word) FILTER (word IS NOT NULL) AS ws
              FROM articles LEFT JOIN doc_top USING (id) GROUP BY id)
        SELECT id, len(list_intersect(coalesce(ws, []), (SELECT list(word) FROM wanted)))::INT AS shared,
               (40 + len(coalesce(ws, [])) - len(list_intersect(coalesce(ws, []), (SELECT list(word) FROM wanted))))::INT AS joined
        FROM d""",
)
def shared_words_rank(spark, sf):
    counts = corpus_word_count(c.segmented(spark, sf))
    wanted = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(40).collect()]
    return sim.shared_words_rank(c.docvecs(spark, sf), wanted).select("id", "shared", "joined")
