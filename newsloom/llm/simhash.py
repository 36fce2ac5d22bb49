"""SimHash near-duplicates found by a self-join of a binary trie of fingerprints.

A fingerprint is read as a path of 64 bits. Pairs of trie nodes are walked down together;
their differing bits add up, and a pair is left as soon as the sum passes the budget. Of
five segments of the 64 bits, two fingerprints at four or fewer differing bits share one
whole, so the trie is built once for each rotation that puts a segment first, and no error
is allowed inside that segment. A subtree below a prefix is the unit of work.

Nothing lists pairs: a task joins what it finds into local components and returns one edge
per member. Node pairs whose leaves are all in one component already are left, so that a
dense ball of near copies isn't walked pair by pair. A subtree that holds more than
``SUBTREE`` fingerprints is dealt into salts, and every pair of salts is a task of its own.

Edge cases: a null or empty text has no word and fingerprint zero, and is linked like any
other; repeated rows are returned as often as they occur; an empty table gives no row; a
null id stays null and never names a component, unless its whole class has null ids. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import components, map_texts, space_words, stage
from newsloom.plans.staging import broadcast_if_small

WIDTH = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints of one task's subtree, and of a subtree on average.
SUBTREE, MEAN = 1 << 16, 512
#: Node pairs with fewer leaf pairs are compared leaf by leaf.
SMALL = 64
_BATCH = 1 << 15


def shingle_hashes(data: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included."""
    words = space_words(data)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())), np.uint64, len(starts)
    )


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """Bits set in over half of the shingle hashes; zero without words."""
    hashes = shingle_hashes(data, width)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BATCH):
        part = hashes[at: at + _BATCH].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, fp); fp holds the 64 bits as a signed long."""

    def rows(ids, texts):
        for i, text in zip(ids, texts):
            fp = fingerprint(text, width)
            yield i, fp - (1 << 64) if fp >> 63 else fp

    return map_texts(docs, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long", rows, binary=True)


def _find(parent: list, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _leaves(lo1, hi1, lo2, hi2) -> tuple[np.ndarray, np.ndarray]:
    """All leaf pairs of the given node pairs."""
    n1, n2 = hi1 - lo1, hi2 - lo2
    each = n1 * n2
    at = np.repeat(np.arange(len(each)), each)
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return lo1[at] + k // n2[at], lo2[at] + k % n2[at]


def trie_components(values: np.ndarray, max_bits: int, exact: int) -> np.ndarray:
    """Index of the smallest value linked to each of ``values`` (sorted, distinct uint64).

    ``exact``: leading bits in which a pair of this trie doesn't differ.
    """
    n = len(values)
    parent = list(range(n))
    comp = np.arange(n)
    for budget in range(1, max_bits + 1):
        stop = np.append(np.flatnonzero(comp[1:] != comp[:-1]) + 1, n)
        run = stop[np.searchsorted(stop, np.arange(n), side="right")]
        one = np.array([0])
        todo = [(0, one, one + n, one, one + n, one)]
        while todo:
            depth, lo1, hi1, lo2, hi2, err = todo.pop()
            same = (run[lo1] >= hi1) & (run[lo2] >= hi2) & (comp[lo1] == comp[lo2])
            few = (hi1 - lo1) * (hi2 - lo2) <= SMALL
            leaf = (few | (depth == 64)) & ~same
            if leaf.any():
                a, b = _leaves(lo1[leaf], hi1[leaf], lo2[leaf], hi2[leaf])
                near = np.bitwise_count(values[a] ^ values[b]) <= budget
                near &= comp[a] != comp[b]
                for x, y in zip(a[near].tolist(), b[near].tolist()):
                    x, y = _find(parent, x), _find(parent, y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
            rest = ~(same | leaf)
            if depth == 64 or not rest.any():
                continue
            lo1, hi1, lo2, hi2, err = (x[rest] for x in (lo1, hi1, lo2, hi2, err))
            shift = np.uint64(63 - depth)

            def cut(lo, hi, shift=shift):
                # First leaf of a node whose bit at this depth is set.
                bit = np.uint64(1) << shift
                first = ((values[lo] >> shift) | np.uint64(1)) << shift
                return np.where(values[hi - 1] & bit, np.searchsorted(values, first), hi)

            mid1, mid2 = cut(lo1, hi1), cut(lo2, hi2)
            self_pair = lo1 == lo2
            apart = err + 1
            children = [
                (lo1, mid1, lo2, mid2, err, None), (mid1, hi1, mid2, hi2, err, None),
                (lo1, mid1, mid2, hi2, apart, None), (mid1, hi1, lo2, mid2, apart, ~self_pair),
            ]
            parts = []
            for a, b, c, d, e, keep in children:
                ok = (a < b) & (c < d) & (e <= (0 if depth < exact else budget))
                if depth < exact and e is err:
                    ok = (a < b) & (c < d)
                if keep is not None:
                    ok &= keep
                parts.append([x[ok] for x in (a, b, c, d, e)])
            merged = [np.concatenate(x) for x in zip(*parts)]
            for at in range(0, len(merged[0]), 1 << 18):
                todo.append((depth + 1, *(x[at: at + (1 << 18)] for x in merged)))
        comp = np.array([_find(parent, x) for x in range(n)])
    return comp


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``max_bits`` + 1 segments of the 64 bits."""
    k = max_bits + 1
    cuts = [64 * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _rotated(fp: str, by: int):
    # Signed longs: the arithmetic shift's leading ones are cut off by the unsigned one.
    return F.col(fp) if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def links(distinct: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) exactly as the links do."""
    spark = distinct.sparkSession
    total = distinct.count()
    parts = segments(max_bits)
    depth = min(min(w for _, w in parts), max(0, (total // MEAN).bit_length()))
    rows = distinct.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("seg"), F.lit(width).alias("width"), _rotated("fp", first).alias("path"))
            for i, (first, width) in enumerate(parts)
        ])).alias("p"),
    ).select("p.seg", "p.width", "p.path", (F.shiftrightunsigned("p.path", 64 - depth) if depth else F.lit(0).cast("long")).alias("prefix"))
    # At most (max_bits + 1) * 2 ** depth rows, and depth is at most a segment's width.
    large = rows.groupBy("seg", "prefix").agg(F.ceil(F.count(F.lit(1)) / SUBTREE).cast("int").alias("salts")).where("salts > 1")
    salted = (
        rows.join(F.broadcast(large), ["seg", "prefix"], "left")
        .withColumn("salts", F.coalesce("salts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("path", F.lit(7)), F.col("salts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        # With several salts, a pair (s, s) is covered by every pair that s is in.
        .where("salts = 1 or own <> other")
        .select("seg", "width", "prefix", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "path")
    )
    key = ["seg", "prefix", "s", "t"]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), total * len(parts) // (2 * SUBTREE) + 1)
    dealt = salted.repartition(tasks, *key).sortWithinPartitions(*key)
    firsts = [first for first, _ in parts]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(segment: int, width: int, paths: list[np.ndarray]) -> pa.RecordBatch:
            values = np.unique(np.concatenate(paths).astype(np.int64).view(np.uint64))
            root = trie_components(values, max_bits, width)
            by = np.uint64(firsts[segment])
            back = values if by == 0 else (values >> by) | (values << (np.uint64(64) - by))
            back = back.view(np.int64)
            linked = np.flatnonzero(root != np.arange(len(values)))
            return pa.RecordBatch.from_arrays([pa.array(back[root[linked]]), pa.array(back[linked])], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            columns = [batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in key]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            path = batch.column(batch.schema.names.index("path")).to_numpy(zero_copy_only=False)
            wide = batch.column(batch.schema.names.index("width")).to_numpy(zero_copy_only=False)
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                this = (*(int(c[a]) for c in columns), int(wide[a]))
                if now is not None and this != now:
                    yield solve(now[0], now[-1], held)
                    held = []
                now = this
                held.append(path[a:b])
        if held:
            yield solve(now[0], now[-1], held)

    return dealt.mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id) of every row of ``docs``.

    Documents link at ``max_bits`` or fewer differing bits; a component is named by the
    smallest doc_id in it.
    """
    marked = stage(fingerprints(docs, width=width))
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = stage(components(links(distinct.select("fp"), max_bits=max_bits)))
    classes = distinct.join(member, distinct.fp == member.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, *, width: int = WIDTH, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest id (then text hash)."""
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("i"), F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))
    marks = stage(near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), width=width, max_bits=max_bits))
    other = stage(marks.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct())
    kept = keyed.join(broadcast_if_small(other), "key", "left_anti")
    # Equal rows have equal keys; of those that are left, one stays.
    again = stage(marks.where("doc_id = component_id").groupBy(F.col("doc_id").alias("key")).count().where("count > 1").select("key"))
    if not again.isEmpty():
        again = broadcast_if_small(again)
        kept = kept.join(again, "key", "left_anti").unionByName(kept.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select("row.*")
