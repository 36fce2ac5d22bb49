"""Keyword ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.codecs import encode_pairs
from newsloom.operators import keywords as op
from newsloom.plans.staging import broadcast_if_small, stage
from newsloom.registry import corpus as c
from newsloom.registry import query
from newsloom.sources.articles import to_terms

# Centrality in the pairwise form of its definition.
NOUNS = c.with_bodies(c.VECTORS) + """,
nouns AS MATERIALIZED (
  SELECT id, word, count(*) AS tf, max(CASE WHEN sentence = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS in_title,
         min(sentence * 4294967296 + pos) AS first_place
  FROM tokens SEMI JOIN wordvecs USING (word)
  WHERE NOT regexp_full_match(word, '[0-9]+') GROUP BY id, word),
central AS MATERIALIZED (
  SELECT n.id, n.word, any_value(n.tf) AS tf, any_value(n.in_title) AS in_title,
         any_value(n.first_place) AS first_place,
         round(sum(CASE WHEN m.word <> n.word THEN list_dot_product(v.vec, u.vec) ELSE 0 END), 9) AS sim
  FROM nouns n JOIN nouns m ON m.id = n.id
  JOIN wordvecs v ON v.word = n.word JOIN wordvecs u ON u.word = m.word
  GROUP BY n.id, n.word)"""


def blend_sql(tfidf="s.idf * c.tf", in_title="c.in_title", w=(1, 1, 1), k=3, join=""):
    return f"""
blended AS (SELECT c.id, c.word, c.sim, {tfidf} AS tfidf, {in_title} AS in_title
            FROM central c JOIN stats s USING (word) {join}),
spans AS (SELECT *, min(sim) OVER p AS slo, max(sim) OVER p AS shi,
                 min(tfidf) OVER p AS tlo, max(tfidf) OVER p AS thi
          FROM blended WINDOW p AS (PARTITION BY id)),
scores AS (SELECT id, word, round(
    {w[0]} * (sim - slo) / CASE WHEN shi > slo THEN shi - slo ELSE 1 END
  + {w[1]} * (tfidf - tlo) / CASE WHEN thi > tlo THEN thi - tlo ELSE 1 END
  + {w[2]} * in_title, 6) AS score FROM spans),
ranked AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY score DESC, word))::INT AS rank,
                  word, score FROM scores)
SELECT id, rank, word, score FROM ranked WHERE rank <= {k}"""


def inputs(spark, sf, headline=c.HEADLINE):
    stats = c.stats(spark, sf)
    return to_terms(c.segmented(spark, sf, headline)), c.word_vectors(spark, sf, stats), stats


@query("semantic_keywords", f"WITH {NOUNS}, {blend_sql()}")
def semantic_keywords(spark, sf):
    return op.semantic_keywords(*inputs(spark, sf))


@query(
    "semantic_keywords_corpus_tf",
    f"WITH {NOUNS}, {blend_sql('s.idf * s.tf', w=(0.5, 2, 1))}",
)
def semantic_keywords_corpus_tf(spark, sf):
    return op.semantic_keywords(
        *inputs(spark, sf), tfidf="corpus", w_sim=0.5, w_tfidf=2.0, min_len=2
    )


@query(
    "semantic_keywords_raw_title",
    f"""WITH {NOUNS}, {blend_sql('s.idf', "CASE WHEN contains(lower(a.title), c.word) THEN 1.0 ELSE 0.0 END",
                                 (4, 2, 4), join="JOIN articles a ON a.id = c.id")}""",
)
def semantic_keywords_raw_title(spark, sf):
    ranked = op.semantic_keywords(
        *inputs(spark, sf), tfidf="idf", w_sim=4.0, w_tfidf=2.0, w_title=4.0, require_idf=True,
        titles=c.articles(spark, sf, c.HEADLINE),
    )
    return ranked


_FOLD = """list_reduce(list_prepend({{'high': 0.0::DOUBLE, 'low': 0.0::DOUBLE}},
  list(struct_pack(high := {x}, low := {x}) ORDER BY first_place)),
  lambda acc, v: CASE WHEN acc.high < v.high THEN struct_pack(high := v.high, low := acc.low)
                      ELSE struct_pack(high := acc.high, low := v.high) END)"""


@query(
    "semantic_keywords_legacy_scaling",
    f"""WITH {NOUNS}, b AS (SELECT c.*, s.idf * c.tf AS tfidf FROM central c JOIN stats s USING (word)),
        f AS (SELECT id, {_FOLD.format(x='sim')} AS sf, {_FOLD.format(x='tfidf')} AS tff FROM b GROUP BY id),
        s2 AS (SELECT id, word, round((sim - sf.low) / CASE WHEN sf.high <> sf.low THEN sf.high - sf.low ELSE 1 END
              + (tfidf - tff.low) / CASE WHEN tff.high <> tff.low THEN tff.high - tff.low ELSE 1 END
              + in_title, 6) AS score FROM b JOIN f USING (id)),
        r AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY score DESC, word))::INT AS rank, word, score FROM s2)
        SELECT id, rank, word, score FROM r WHERE rank <= 3""",
)
def semantic_keywords_legacy(spark, sf):
    return op.semantic_keywords(*inputs(spark, sf), scaling="legacy")


@query(
    "word_centrality",
    f"""WITH {NOUNS} SELECT id, word, tf, in_title, {c.shown_sql('sim', 5)} AS sim FROM central""",
)
def word_centrality(spark, sf):
    terms, vecs, stats = inputs(spark, sf)
    vocab = stage(op.vocabulary(vecs, stats))
    central = op.word_centrality(op.article_nouns(terms, broadcast_if_small(vocab.select("word"))), vocab)
    return central.select("id", "word", "tf", "in_title", c.shown(F.col("sim"), 5).alias("sim"))


@query(
    "keyword_strings",
    f"""WITH {NOUNS}, {blend_sql().replace('SELECT id, rank, word, score FROM ranked WHERE rank <= 3', '')}
        SELECT id, string_agg(word || ':1', ',' ORDER BY rank) AS kw FROM ranked WHERE rank <= 3 GROUP BY id""",
)
def keyword_strings(spark, sf):
    lists = op.keyword_lists(op.semantic_keywords(*inputs(spark, sf)))
    ones = F.transform("kw", lambda p: F.struct(p["word"].alias("word"), F.lit(1).alias("weight")))
    return lists.select("id", encode_pairs(ones).alias("kw"))
