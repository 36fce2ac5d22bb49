"""Corpus statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import stats as op
from newsloom.registry import corpus as c
from newsloom.registry import query
from newsloom.sources.articles import to_terms

# A lexicon rule that hands out every kind of nature the vocabulary filter looks at.
_NATURE_SQL = """CASE length(word) % 7 WHEN 0 THEN 'v' WHEN 1 THEN 'nx' WHEN 2 THEN 'mz'
  WHEN 3 THEN 'mbk' WHEN 4 THEN 'm' ELSE 'nz' END"""


def nature_rule(word):
    n = F.length(word) % 7
    kinds = {0: "v", 1: "nx", 2: "mz", 3: "mbk", 4: "m"}
    out = F.lit("nz")
    for k, v in kinds.items():
        out = F.when(n == k, F.lit(v)).otherwise(out)
    return out


@query("tfidf_stats", f"WITH {c.STATS} SELECT word, tf, df, round(idf, 6) AS idf FROM stats")
def tfidf_stats(spark, sf):
    return op.tfidf_stats(c.segmented(spark, sf)).withColumn("idf", F.round("idf", 6))


@query(
    "tfidf_top_terms",
    f"""WITH {c.STATS} SELECT word, tf, round(tf * idf, 4) AS weight FROM stats
        ORDER BY round(tf * idf, 4) DESC, word LIMIT 20""",
)
def tfidf_top_terms(spark, sf):
    weighted = op.tfidf_stats(c.segmented(spark, sf)).select(
        "word", "tf", F.round(F.col("tf") * F.col("idf"), 4).alias("weight")
    )
    return weighted.orderBy(F.desc("weight"), "word").limit(20)


@query(
    "stop_words",
    f"WITH {c.STATS} SELECT word FROM stats WHERE idf <= 3 OR tf > 2000",
)
def stop_words(spark, sf):
    return op.stop_words(op.tfidf_stats(c.segmented(spark, sf)), tf_min=2000)


@query(
    "doc_term_freq",
    f"""WITH {c.TOKENS}, {c.DOC_TF} SELECT id, word, tf,
        round(tf / sum(tf) OVER (PARTITION BY id), 8) AS rel_tf FROM doc_tf""",
)
def doc_term_freq(spark, sf):
    return op.doc_tf(c.segmented(spark, sf)).withColumn("rel_tf", F.round("rel_tf", 8))


@query("corpus_word_count", f"WITH {c.TOKENS} SELECT word, count(*) AS n FROM tokens GROUP BY word")
def corpus_word_count(spark, sf):
    return op.corpus_word_count(c.segmented(spark, sf))


@query(
    "noun_vocabulary",
    f"""WITH {c.TOKENS}, tagged AS (SELECT word, {_NATURE_SQL} AS nature FROM tokens)
        SELECT DISTINCT word FROM tagged
        WHERE (nature LIKE 'n%' AND nature NOT LIKE 'nx%') OR nature LIKE 'mz%' OR nature = 'mbk'""",
)
def noun_vocabulary(spark, sf):
    return op.noun_vocabulary(to_terms(c.segmented(spark, sf), nature=nature_rule))
