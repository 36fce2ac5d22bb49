"""The training-data pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's documents. All but the last return the columns of ``docs``. Null and empty texts, ties,
repeated rows, empty tables and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, line_dedup, packing, quality, simhash
from newsloom.llm.common import read_table, stage


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that lose every line go, n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs.select(F.struct("*").alias("row"), "doc_id", "text"))
    before = F.col("row.text")
    changed = ~F.col("text").eqNullSafe(before)
    columns = [
        F.col("text") if c == "text"
        else F.when(changed, F.length("text")).otherwise(F.col("row")[c]).cast(kind).alias(c) if c == "n_chars"
        else F.col("row")[c].alias(c)
        for c, kind in docs.dtypes
    ]
    return cut.where(~changed | F.col("text").rlike(r"\S")).select(*columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_documents),
    ("best_fit_packing", pack),
]

#: Fitted models, tokenizers and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
