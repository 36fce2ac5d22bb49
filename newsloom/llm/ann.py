"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns a unit vector by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and takes the nearest signed axis, the largest coordinate by size (Andoni et al., 2015).
Every row is indexed in ``tables`` tables; a query probes the ``probes`` nearest axes in each, and
what the buckets hold is ranked by the exact distance of the original vectors. With ``hashes`` of 2 a
bucket is a pair of axes, for tables beyond some ten million rows.

Rows travel to their buckets, queries to the buckets they probe. A bucket with more than ``CHUNK``
rows or queries is dealt into salts, every pair of which is a group of bounded size, so a third of
all rows in one bucket is no large task; each group returns its best ``k`` per query. A query that
finds fewer than ``k`` is compared with all rows, in blocks of bounded broadcasts.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those whose length isn't the commonest one (the smaller on ties), nor rows with a null id; rows of a
query's own id aren't its candidates; among equal distances the smaller id comes first; of repeated
rows of one id the nearest counts; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stage

TABLES, PROBES, HASHES, SEED = 16, 4, 1, 5
#: Rows, and queries, of one group; queries of one block.
CHUNK, BLOCK = 8192, 2048


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, -1, 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


class CrossPolytope:
    """Hash tables over vectors of one length."""

    def __init__(self, dim: int, tables: int, hashes: int, seed: int):
        self.dim, self.width = dim, 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def turned(self, unit: np.ndarray, table: int, which: int) -> np.ndarray:
        x = np.zeros((len(unit), self.width))
        x[:, : self.dim] = unit
        for sign in self.signs[table, which]:
            x = _hadamard(x * sign)
        return x

    def codes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Bucket of each row: signed axes, 2 * width of them per hash."""
        code = np.zeros(len(unit), np.int64)
        for which in range(self.signs.shape[1]):
            x = self.turned(unit, table, which)
            axis = np.abs(x).argmax(1)
            code = code * 2 * self.width + 2 * axis + (x[np.arange(len(x)), axis] < 0)
        return code

    def probe(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The ``probes`` buckets nearest to each row, best first."""
        best = score = None
        for which in range(self.signs.shape[1]):
            x = self.turned(unit, table, which)
            both = np.stack([x, -x], 2).reshape(len(x), -1)
            near = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            value = np.take_along_axis(both, near, 1)
            if best is None:
                best, score = near, value
                continue
            # Pairs of axes by the sum of both coordinates.
            pairs = (best[:, :, None] * 2 * self.width + near[:, None, :]).reshape(len(x), -1)
            total = (score[:, :, None] + value[:, None, :]).reshape(len(x), -1)
            order = np.argsort(-total, axis=1, kind="stable")[:, :probes]
            best, score = np.take_along_axis(pairs, order, 1), np.take_along_axis(total, order, 1)
        return best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _best(query_ids, queries, ids, vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of queries and vectors, and exact distances, of each query's k nearest."""
    out, eps = [], np.finfo(float).eps
    # Around the group's middle, as the rough distances lose what the norms are larger by.
    middle = vectors.mean(0) if len(vectors) else 0.0
    moved = vectors - middle
    norms = np.sqrt((moved**2).sum(1))
    for at in range(0, len(queries), 256):
        q, own = queries[at: at + 256], query_ids[at: at + 256]
        near = q - middle
        size = np.sqrt((near**2).sum(1)) + norms.max(initial=0.0)
        rough = (near**2).sum(1)[:, None] + norms**2 - 2 * near @ moved.T
        rough[own[:, None] == ids[None, :]] = np.inf
        if rough.shape[1] > k:
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
            # The slack covers the rounding of the products, by the norms, and of the moves, by the
            # coordinates moved, so no true neighbour is cut.
            dim = vectors.shape[1]
            moves = eps * np.sqrt(dim) * 4 * (np.abs(q).max(1) + np.abs(vectors).max() + size)
            slack = 8 * (dim + 8) * eps * size**2 + moves * (4 * np.sqrt(np.abs(edge)) + 4 * moves)
            i, j = np.nonzero(rough <= (edge + slack)[:, None])
        else:
            i, j = np.nonzero(np.isfinite(rough))
        keep = np.isfinite(rough[i, j])
        i, j = i[keep], j[keep]
        exact = np.sqrt(((q[i] - vectors[j]) ** 2).sum(1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        out.append((i[rank < k] + at, j[rank < k], exact[rank < k]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col(vec_col)
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
    ).where(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    )
    return good


def nearest(
    rows: DataFrame, queries: DataFrame, *, k: int = 10, tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES,
    seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of every query."""
    spark = rows.sparkSession
    good = _usable(rows, id_col, vec_col)
    common = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = int(common["n"])
    index = good.where(F.size("vec") == dim)
    asked = _usable(queries, id_col, vec_col).where(F.size("vec") == dim)
    hasher = CrossPolytope(dim, tables, hashes, seed)

    def hashed(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1), dim)
                # Scaled first, so that neither tiny nor huge components are lost in squares.
                x = x / np.abs(x).max(1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                take = pa.array(np.arange(batch.num_rows))
                for t in range(tables):
                    codes = hasher.probe(unit, t, probes) if probe else hasher.codes(unit, t)[:, None]
                    for column in codes.T:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(take), t, np.int32)), pa.array(column), batch.column(0), batch.column(1)],
                            names=["tbl", "code", "vec_id", "vec"],
                        )

        return run

    kind = dict(index.dtypes)["vec"]
    layout = f"tbl int, code long, vec_id long, vec {kind}"
    held, wanted = index.mapInArrow(hashed(False), layout), asked.mapInArrow(hashed(True), layout)
    # At most tables * (2 * width) ** hashes rows.
    def salts(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("tbl", "code").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))

    deal = stage(salts(held, "vs").join(salts(wanted, "qs"), ["tbl", "code"]))

    def dealt(frame: DataFrame, own: str, other: str) -> DataFrame:
        return (
            frame.join(F.broadcast(deal), ["tbl", "code"])
            .withColumn(own[0] + "k", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
            .withColumn(other[0] + "k", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select("tbl", "code", "vk", "qk", "vec_id", "vec")
        )

    key = ["tbl", "code", "vk", "qk"]

    def rank(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, query_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        i, j, exact = _best(query_ids, np.stack(right["vec"]).astype(np.float64), ids, np.stack(left["vec"]).astype(np.float64), k)
        return pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[j], "score": exact})

    found = dealt(held, "vs", "qs").groupBy(*key).cogroup(dealt(wanted, "qs", "vs").groupBy(*key)).applyInPandas(
        rank, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def cut(frame: DataFrame) -> DataFrame:
        once = frame.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = stage(cut(found))
    full = first.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = stage(asked.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return first
    parts = [first.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")]
    block = []
    for row in short.toLocalIterator():
        block.append((row[0], [float(x) for x in row[1]]))
        if len(block) == BLOCK:
            parts.append(cut(_scan(index, block, dim, k)))
            block = []
    if block:
        parts.append(cut(_scan(index, block, dim, k)))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _scan(index: DataFrame, block: list, dim: int, k: int) -> DataFrame:
    """Best candidates of a block of queries in every batch of all rows."""
    share = index.sparkSession.sparkContext.broadcast((np.array([b[0] for b in block]), np.array([b[1] for b in block])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = share.value
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                i, j, exact = _best(ids, queries, own, _matrix(batch.column(1), dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j]), pa.array(exact)], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")
