"""Best-fit packing of tokenised documents into sequences.

Pieces are dealt into groups of about ``GROUP`` by a hash, and each group is packed by
itself: pieces go longest first, and among the open sequences that have room under every
constraint (tokens, documents, attention cost) the one is taken that a weighted score puts
first: ``residual`` (smallest weighted norm of what stays free) or ``dot`` (largest weighted
dot product of the piece's needs with what is free). A group leaves at most a sequence or
two that smaller pieces of other groups could have filled, one in some thousand.

Edge cases: a null or empty text has only the end id; a longer document is cut into pieces of
``capacity`` tokens, the last one shorter; repeated rows are packed as often as they occur; an
empty table gives no row; columns other than the id and text aren't read. A piece that exceeds
a constraint by itself gets a sequence of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import per_worker, stage, text_chunks
from newsloom.llm.word_ids import WordIds, spans, tokenizer_path

CAPACITY = 4096
END_ID = 1
GROUP = 8192
#: Bytes of text that a worker has ids of at a time.
CHUNK_BYTES = 2 << 20


def pieces(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(f"word ids {path}", lambda: WordIds(path))
        for keys, texts in text_chunks(batches, CHUNK_BYTES):
            ids, bounds = coder(texts, end_id)
            data, sizes = memoryview(ids).cast("B"), np.diff(bounds)
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = spans(np.zeros(len(counts), np.int64), counts)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            cuts = zip((4 * (bounds[row] + start)).tolist(), (4 * (bounds[row] + start + length)).tolist())
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(data[a:b]) for a, b in cuts], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(
    needs: np.ndarray, capacity: np.ndarray, weights: np.ndarray, *, rule: str = "residual",
) -> np.ndarray:
    """Bin of every row of ``needs`` (n x dimensions), which come in order of placement."""
    n = len(needs)
    free = np.empty((n, needs.shape[1]))
    scale = weights / capacity
    label = np.empty(n, np.int64)
    bins = np.empty(n, np.int64)
    least = needs[::-1].copy()
    np.minimum.accumulate(least, axis=0, out=least)
    least = least[::-1]  # the smallest need still to come, by dimension
    used = opened = 0
    for i in range(n):
        need = needs[i]
        if i % 256 == 0 and used:  # sequences that nothing to come fits into are closed
            keep = np.flatnonzero((free[:used] >= least[i]).all(axis=1))
            free[: len(keep)], label[: len(keep)] = free[keep], label[keep]
            used = len(keep)
        at = -1
        if used:
            fits = np.flatnonzero((free[:used] >= need).all(axis=1))
            if len(fits):
                room = free[fits]
                if rule == "dot":
                    score = -((room * scale) @ (need * scale))
                else:
                    score = (((room - need) * scale) ** 2).sum(axis=1)
                at = fits[np.argmin(score)]
        if at < 0:
            at, used = used, used + 1
            free[at], label[at] = capacity, opened
            opened += 1
        free[at] -= need
        bins[i] = label[at]
    return bins


def pack(
    pieces: DataFrame, *, capacity: int = CAPACITY, max_docs: int = CAPACITY, max_attention: int = CAPACITY**2,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "residual", group: int = GROUP,
) -> DataFrame:
    """``pieces`` with sequence_id and the offset of each piece in its sequence.

    ``max_docs`` and ``max_attention`` bound the pieces of a sequence and the sum of their
    squared lengths; by default tokens bind first. ``weights`` belong to tokens, documents
    and attention cost.
    """
    groups = max(1, -(-pieces.count() // group))
    limits, shares = np.array([capacity, max_docs, max_attention], float), np.array(weights, float)

    def fill(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        length = frame["length"].to_numpy(np.float64)
        needs = np.stack([length, np.ones(len(length)), length**2], axis=1)
        frame["sequence_id"] = (int(key[0]) << 32) + best_fit(needs, limits, shares, rule=rule)
        size = frame["length"]
        frame["offset"] = size.groupby(frame["sequence_id"]).cumsum() - size
        return frame.drop(columns="grp")

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(
        fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, *, path: str | None = None, **limits) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack the pieces."""
    capacity = limits.get("capacity", CAPACITY)
    return pack(stage(pieces(docs, path=path, capacity=capacity)), **limits)
