"""Compression of vectors to codes by product quantisation in exact integer arithmetic.

Components become integers, a vector is cut into equal parts, and each part is replaced by the number of
its nearest codebook entry. The nearest entry is the first least of |c|^2 - 2 v.c. Dot products come
from float64 matrix products without rounding: integers are broken into limbs so short that a sum of
products of limbs stays below 2^53, limbs are multiplied as matrices, and the products are put together in
int64. How many limbs there are follows from the largest magnitudes in a tile; small components need one.

A round is one pass: tasks assign their rows and hand on sums and counts per entry, which are added up
before and after the shuffle. The driver gets the summed codebooks only, whatever the number of rows.

Edge cases: vectors null, empty, with null or non-finite components, or not of the table's most frequent length
(of several, the shortest) take no part; among equal ids the smaller vector comes first in the first codebooks and
null ids come last; with fewer vectors than entries the codebooks are as small as that; repeated rows count as
often as they occur; an empty table gives no row; other columns aren't read. A length that the
parts don't divide is an error, and so are components whose squared distances exceed 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stage
from newsloom.plans.staging import broadcast_if_small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
TILE_ROWS = 4096
#: Bits of an integer that float64 holds.
EXACT_BITS = 53


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Float matrices of ``width`` bits each, lowest first, that make up ``x``; the last has its sign."""
    out = []
    while x.size and (x.max() >= 1 << width or x.min() < -(1 << width)):
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width
    return [*out, x.astype(np.float64)]


def exact_dots(a: np.ndarray, b: np.ndarray, exact_bits: int = EXACT_BITS) -> np.ndarray:
    """All dot products of the rows of two int64 matrices; right if they fit 64 bits."""
    width = (exact_bits - 1 - max(1, a.shape[1] - 1).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    rights = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(rights):
            # Beyond 64 bits shifts and sums wrap around, which leaves a result that fits as it is.
            if width * (i + j) < 64:
                out += (x @ y.T).astype(np.int64) << (width * (i + j))
    return out


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of several, and its squared distance."""
    top = max(int(np.abs(x).max(initial=0)) for x in (rows, book))
    if rows.shape[1] * (2 * top) ** 2 >= 1 << 63:
        raise ValueError(f"components up to {top}: squared distances exceed 64 bits")
    score = (book * book).sum(axis=1) - 2 * exact_dots(rows, book)
    at = score.argmin(axis=1)
    return at, score[np.arange(len(rows)), at] + (rows * rows).sum(axis=1)


def integers(column: pa.Array, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components as integers."""
    sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = (sizes == dim) & (odd[starts + sizes] == odd[starts])
    rows = values[starts[keep][:, None] + np.arange(dim)] if keep.any() else np.zeros((0, dim))
    scaled = np.floor(rows * scale)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("a component exceeds 64 bits")
    return keep, scaled.astype(np.int64)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _first_books(rows: DataFrame, dim: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """Codebooks (part, entry, component) of the vectors with the smallest ids."""
    first = rows.where(usable(F.col("vec")) & (F.size("vec") == dim)).orderBy(F.asc_nulls_last("id"), "vec").limit(entries)
    _, found = integers(first.select("vec").toArrow()["vec"].combine_chunks(), dim, scale)
    return found.reshape(len(found), parts, dim // parts).transpose(1, 0, 2).copy()


def _tiles(batches: Iterator[pa.RecordBatch], dim: int, parts: int, scale: int):
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            tile = batch.slice(at, TILE_ROWS)
            keep, found = integers(tile.column("vec"), dim, scale)
            if len(found):
                yield tile.filter(pa.array(keep)), found.reshape(len(found), parts, -1)


def _sums(rows: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """Rows (part, entry, n, s0, s1, ...): parts nearest to an entry, and their sums."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for _, tile in _tiles(batches, parts * width, parts, scale):
            for p in range(parts):
                own = np.ascontiguousarray(tile[:, p])
                at, _ = nearest(own, books[p])
                np.add.at(sums[p], at, own)
                counts[p] += np.bincount(at, minlength=entries)
        p, e = np.nonzero(counts)
        columns = {"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e])}
        yield pa.RecordBatch.from_pydict(columns | {f"s{k}": pa.array(sums[p, e, k]) for k in range(width)})

    names = [f"s{k}" for k in range(width)]
    found = rows.select("vec").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names))
    return found.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *names]))


def fit(
    rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding",
) -> np.ndarray | None:
    """Codebooks (part, entry, component) after ``rounds`` of assignment and means, all rounded down; None without vectors."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    lengths = rows.where(usable(F.col("vec"))).groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "d").first()
    if common is None:
        return None
    if common.d % parts:
        raise ValueError(f"{parts} parts don't divide {common.d} components")
    books = _first_books(rows, common.d, parts, entries, scale)
    for _ in range(rounds):
        found = _sums(rows, books, scale).toArrow()
        p, e, n = (found[c].to_numpy() for c in ("part", "entry", "n"))
        sums = np.stack([found[f"s{k}"].to_numpy() for k in range(books.shape[2])], axis=1)
        books = books.copy()
        books[p, e] = sums // n[:, None]
    return books


def compress(
    rows: DataFrame, books: np.ndarray, *, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Rows (vec_id, label, code, error) of the vectors that take part."""
    parts, _, width = books.shape
    kinds = dict(rows.dtypes)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for kept, tile in _tiles(batches, parts * width, parts, scale):
            found = [nearest(np.ascontiguousarray(tile[:, p]), books[p]) for p in range(parts)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            error = np.sum([distance for _, distance in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [kept.column("id"), kept.column("label"), pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    read = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    return read.mapInArrow(run, f"vec_id {kinds[id_col]}, label {kinds[label_col]}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(rows: DataFrame, **options) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256): fits codebooks and codes every vector."""
    books = fit(rows, **options)
    kind = rows.schema[options.get("id_col", "vec_id")].dataType.simpleString()
    if books is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = stage(compress(rows, books, **{k: v for k, v in options.items() if k in ("scale", "id_col", "vec_col")}))
    by_label = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    return coded.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
