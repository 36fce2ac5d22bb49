"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newsloom.plans.staging import shared_dir, stage, unstage

__all__ = [
    "SPACE_LOWER", "WORD_LOWER", "components", "crc_mod", "filter_texts", "map_texts", "per_worker", "read_table", "shared_dir", "space_words",
    "stage", "text_chunks", "unstage", "word_runs",
]

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Lower-cases A-Z and leaves every other byte of UTF-8 alone.
SPACE_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: The same, and turns ASCII bytes other than letters and digits into blanks.
WORD_LOWER = bytes(
    b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in SPACE_LOWER
)


def space_words(data: bytes) -> list[bytes]:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed, return."""
    return data.translate(SPACE_LOWER).split()


def word_runs(data: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return data.translate(WORD_LOWER).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column, n: int) -> Column:
    """CRC-32 of the value written as text, modulo ``n``; null for a null value."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def map_texts(
    docs: DataFrame, schema: str, rows: Callable[[list, list], Iterable[tuple]], *,
    id_col: str = "doc_id", text_col: str = "text", binary: bool = False, chunk_chars: int = 8 << 20,
) -> DataFrame:
    """Run ``rows(ids, texts)`` over bounded chunks of documents, without a shuffle.

    Null texts arrive empty. A chunk ends after ``chunk_chars`` characters, so a batch of
    very long texts is worked off in parts; one text always stays whole.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = b"" if binary else ""
        for batch in batches:
            ids = batch.column(0).to_pylist()
            column = batch.column(1)
            texts = (column.cast(pa.binary()) if binary else column).to_pylist()
            start = size = 0
            for end, text in enumerate(texts, 1):
                if text is None:
                    texts[end - 1] = empty
                else:
                    size += len(text)
                if size >= chunk_chars or end == len(texts):
                    made = list(rows(ids[start:end], texts[start:end]))
                    columns = zip(*made) if made else [[] for _ in out]
                    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, out)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=out)
                    start, size = end, 0

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def text_chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int = 4 << 20) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of batches (id, text), in parts of about ``chunk_bytes``; one text always stays whole."""
    for batch in batches:
        sizes = batch.column(1).fill_null("").cast(pa.binary())
        ends = np.frombuffer(sizes.buffers()[1], np.int32)[sizes.offset: sizes.offset + batch.num_rows + 1] if batch.num_rows else np.zeros(1, np.int32)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + chunk_bytes, side="right")) - 1)
            part = batch.slice(at, to - at)
            yield part.column(0), part.column(1)
            at = to


def filter_texts(docs: DataFrame, keep: Callable[[list], list], *, text_col: str = "text", chunk_rows: int = 512) -> DataFrame:
    """Rows of ``docs``, all columns, for whose texts (UTF-8, null as empty) ``keep`` is true; no shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                texts = [t or b"" for t in part.column(place).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def per_worker(key: str, make: Callable, version: str | None = None):
    """A value that a Python worker keeps from task to task, such as a loaded tokenizer; another version replaces it."""
    store = sys.modules.setdefault("newsloom_worker_state", types.ModuleType("newsloom_worker_state")).__dict__
    if key not in store or store[key][0] != version:
        store.pop(key, None)
        store[key] = version, make()
    return store[key][1]


def _fold(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node that has an edge: rows (node, component).

    ``edges`` has two columns of one orderable type. Alternates large and small stars
    (Kiveris et al., 2014): neighbours are combined before each shuffle, so a node with very
    many neighbours is no group in memory, and each round is written to the shared folder.
    Loops and repeated edges are allowed; no edge gives no row.
    """
    left, right = edges.columns
    found = stage(
        edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a < b").distinct()
    )
    mark = _fold(found)
    while mark[0]:
        both = found.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            found.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e")
        ).select("e.a", "e.b").where("a < b").distinct()
        after = stage(small)
        now = _fold(after)
        unstage(found)
        found = after
        if now == mark:
            break
        mark = now
    roots = found.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return found.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
