"""One query per operator over the whole of its table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import (
    alignment, ann, decontaminate, langid, licenses, line_dedup, packing, quality, simhash, token_counts, token_files, toxicity, vector_codes,
)
from newsloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op4_license_scans")
def op4(spark, sf_dir):
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
item_shingles as (
  select distinct item_id, list_aggregate(w[i : i + least(5, len(w)) - 1], 'string_agg', ' ') s, least(5, len(w)) width
  from (select item_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) i from item_words where len(w) > 0)),
sizes as (select item_id, count(*) n from item_shingles group by item_id),
widths as (select distinct width from item_shingles),
doc_shingles as (
  select distinct doc_id, width, list_aggregate(w[i : i + width - 1], 'string_agg', ' ') s
  from (select doc_id, width, w, unnest(range(1, len(w) - width + 2)) i from words, widths where len(w) >= width)),
found as (
  select doc_id, item_id, count(*) / any_value(n) share
  from doc_shingles join item_shingles using (width, s) join sizes using (item_id)
  group by doc_id, item_id having count(*) >= 0.8 * any_value(n)),
held as (select doc_id, list(item_id order by item_id) i, list(share order by item_id) c from found group by doc_id)
select doc_id, i is not null as contaminated, coalesce(i, []) as item_ids, coalesce(c, []) as containment
from documents left join held using (doc_id)
"""


@query("op8_benchmark_decontamination", OP8_SQL)
def op8(spark, sf_dir):
    return decontaminate.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op3_language_id")
def op3(spark, sf_dir):
    return langid.language(read_table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def op6(spark, sf_dir):
    return token_counts.count_edits(read_table(spark, sf_dir, "documents"), token_counts.redactions(), relative=True)


@query("op7_quality_classifier")
def op7(spark, sf_dir):
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op9_nearest_neighbours")
def op9(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"))


@query("op10_line_dedup")
def op10(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, counts=True)


@query("op11_token_files")
def op11(spark, sf_dir):
    return token_files.read_tokens(spark, token_files.write_tokens(read_table(spark, sf_dir, "documents")))


@query("op12_tokenizer_alignment")
def op12(spark, sf_dir):
    return alignment.align_documents(read_table(spark, sf_dir, "documents"))


def _op13_round(k: int) -> str:
    """Codes of round k over the codebooks of round k, and the codebooks of round k + 1."""
    return f"""
near_{k} AS MATERIALIZED (
  SELECT r, p, arg_min(c, (list_dot_product(y, y) - 2 * list_dot_product(x, y)) * 256 + c) AS c
  FROM cut JOIN book_{k} USING (p) GROUP BY r, p),
sums_{k} AS (
  SELECT p, c, pos, floor(sum(v) / count(*)) AS m
  FROM (SELECT r, p, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM cut) JOIN near_{k} USING (r, p) GROUP BY p, c, pos),
book_{k + 1} AS MATERIALIZED (
  SELECT p, c, coalesce(z, y) AS y FROM book_{k}
  LEFT JOIN (SELECT p, c, list(m ORDER BY pos) AS z FROM sums_{k} GROUP BY p, c) USING (p, c))"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
cut AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
book_0 AS MATERIALIZED (SELECT p, r - 1 AS c, x AS y FROM cut WHERE r <= 256),{",".join(_op13_round(k) for k in range(5))},
last AS (
  SELECT r, p, n.c, list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y) AS d
  FROM near_4 n JOIN cut USING (r, p) JOIN book_4 b USING (p, c)),
coded AS (SELECT r, string_agg(format('{{:02x}}', c), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY r),
shown AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, c, pos)) AS codebooks_sha256
  FROM (SELECT p, c, unnest(y) AS x, generate_subscripts(y, 1) AS pos FROM book_4))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), shown
"""


@query("op13_vector_codes", OP13_SQL)
def op13(spark, sf_dir):
    return vector_codes.compress_vectors(read_table(spark, sf_dir, "embeddings"))
