"""Test items found inside long documents by size-partitioned MinHash containment.

The similarity is containment: the part of an item's distinct shingles (five words) that a
document holds. A document of 20,000 words and an item of 30 have a Jaccard similarity of a
thousandth, so bands of whole-document signatures would lose most of them. Items are instead
partitioned by their number of shingles, and all items of a size class are sketched by the same number ``k`` of bottom
MinHash values, as many as the pigeonhole principle asks for at the class's largest size. A document that holds enough
of an item of ``n`` shingles lacks at most ``m = n - ceil(threshold * n)`` of them, so it holds at
least ``k - m`` values of the sketch: fewer, and the item is no candidate. A class whose smallest item needs more shingles
than a document has is passed over. Documents are streamed past the classes with all their shingle hashes, and each
candidate is verified by exact containment of the shingles themselves. So no link is lost.

Sketches are made in the executors and staged. They are dealt into blocks of at most ``BLOCK_BYTES`` as measured (an
item larger than that has a block of its own); the driver forwards one block at a time, and the workers index it.
One block is a single pass over the documents; of several, each is a pass whose hits are staged before its broadcast is given
up. Documents are neither shuffled nor collected.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Edge cases:
an item of fewer than five words is one shingle of all its words; one without words or with a
null text matches nothing; a document with null or empty text holds nothing; repeated items are
reported under each id, in order; repeated rows are returned as often as they occur; an empty
benchmark leaves every document clean. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import filter_texts, map_texts, per_worker, stage, word_runs
from newsloom.plans.staging import broadcast_if_small

WIDTH = 5
THRESHOLD = 0.8
#: Bytes of a block of sketches and items, as broadcast.
BLOCK_BYTES = 32 << 20
_MIX = 0x9E3779B97F4A7C15


def shingles(words: list[bytes], width: int = WIDTH) -> list[tuple[bytes, ...]]:
    """Shingles of consecutive words; all words if there are fewer."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(width))))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], width: int, known: _WordHash) -> np.ndarray:
    """Hash of every run of ``width`` words, from the words' own hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    mix = np.uint64(_MIX)
    for i in range(width):
        total = (total ^ (total >> np.uint64(29))) * mix + each[i: i + n]
    return (total ^ (total >> np.uint64(31))) * mix


def size_class(n: int) -> int:
    """Items of 2**k to 2**(k+1) - 1 shingles are class k."""
    return n.bit_length() - 1


def sketch_size(n: int, threshold: float) -> int:
    """Bottom values of which a match with ``n`` shingles must hold one."""
    return n - math.ceil(round(threshold * n, 9)) + 1


def sketches(benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (item_id, words, width, class, n, hits, hashes, bytes) of the items that have words.

    ``hashes`` are the bottom values, of which a document must hold ``hits``.
    """
    def rows(ids, texts):
        known = _WordHash()
        for i, text in zip(ids, texts):
            words = word_runs(text)
            n = len(set(shingles(words, width)))
            if not n:
                continue
            own = min(width, len(words))
            hashes = np.unique(shingle_hashes(words, own, known))
            largest = (2 << size_class(n)) - 1
            hashes = hashes[: sketch_size(largest, threshold)]
            # Equal hashes of two shingles leave fewer values; one at least is held even then.
            hits = max(1, len(hashes) - (n - math.ceil(round(threshold * n, 9))))
            joined = b" ".join(words)
            yield i, joined, own, size_class(n), n, hits, hashes.view(np.int64).tolist(), len(joined) + 8 * len(hashes) + 64

    return map_texts(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"),
        "item_id long, words binary, width int, class int, n int, hits int, hashes array<long>, bytes long",
        rows, id_col="item_id", binary=True,
    )


class Index:
    """Sketches of a block of items by shingle width and size class."""

    def __init__(self, table: pa.Table, width: int, threshold: float):
        self.threshold = threshold
        self.ids, self.words = table["item_id"].to_pylist(), table["words"].to_pylist()
        self.hits = table["hits"].to_numpy()
        self.n, self.widths = table["n"].to_numpy(), table["width"].to_numpy()
        lists = table["hashes"].combine_chunks()
        flat, owner = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), lists.value_lengths())
        classes = table["class"].to_numpy()
        self.sets: dict[int, frozenset] = {}
        #: {shingle width: (all hashes, [(fewest shingles that a document needs, hashes, items)])}
        self.by_width: dict[int, tuple] = {}
        for own in np.unique(self.widths).tolist():
            mine = self.widths[owner] == own
            parts = []
            for c in np.unique(classes[self.widths == own]).tolist():
                part = np.flatnonzero(mine & (classes[owner] == c))
                part = part[np.argsort(flat[part], kind="stable")]
                parts.append((math.ceil(round(threshold * (1 << c), 9)), flat[part], owner[part]))
            self.by_width[own] = np.unique(flat[mine]), parts

    def need(self, item: int) -> frozenset:
        """Shingles of an item, made when it is a candidate for the first time."""
        if item not in self.sets:
            words = self.words[item].split()
            own = int(self.widths[item])
            self.sets[item] = frozenset(zip(*(words[i:] for i in range(own))))
        return self.sets[item]

    def candidates(self, words: list[bytes], known: _WordHash) -> list[int]:
        """Items of whose sketches the words hold enough."""
        found = []
        for own, (every, parts) in self.by_width.items():
            mine = shingle_hashes(words, own, known)
            if not len(mine):
                continue
            hit = np.unique(mine[every[np.minimum(np.searchsorted(every, mine), len(every) - 1)] == mine])
            if not len(hit):
                continue
            for least, hashes, items in parts:
                if len(mine) < least:
                    continue
                a, b = np.searchsorted(hashes, hit), np.searchsorted(hashes, hit, side="right")
                held = [items[i:j] for i, j in zip(a, b) if i < j]
                if held:
                    items_held, counts = np.unique(np.concatenate(held), return_counts=True)
                    found += items_held[counts >= self.hits[items_held]].tolist()
        return found

    def contained(self, words: list[bytes], known: _WordHash) -> list[tuple[int, float]]:
        """(item id, containment) of every item that the words hold, by id, null ids first."""
        candidates = self.candidates(words, known)
        if not candidates:
            return []
        held = {own: set(zip(*(words[i:] for i in range(own)))) for own in {int(self.widths[k]) for k in candidates}}
        found = []
        for k in candidates:
            share = len(self.need(k) & held[int(self.widths[k])]) / int(self.n[k])
            if share >= self.threshold - 1e-12:
                found.append((self.ids[k], share))
        return sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


class Blocks:
    """Staged sketches in blocks of bounded bytes, of which one at a time goes to the workers."""

    def __init__(self, benchmark: DataFrame, width: int, threshold: float, block_bytes: int):
        self.width, self.threshold = width, threshold
        self.context = benchmark.sparkSession.sparkContext
        self.table = stage(sketches(benchmark, width, threshold))
        total = self.table.agg(F.sum("bytes")).first()[0] or 0
        self.number = max(1, -(-total // block_bytes))
        # Dealt by hash; finer until no block of several different items is too large.
        while self.number > 1:
            dealt = self.table.groupBy(self._block().alias("block")).agg(
                F.sum("bytes").alias("bytes"), F.min("words").alias("low"), F.max("words").alias("high")
            )
            if dealt.where((F.col("bytes") > block_bytes) & (F.col("low") < F.col("high"))).isEmpty():
                break
            self.number *= 2

    def _block(self):
        return F.pmod(F.xxhash64("words"), F.lit(self.number))

    def send(self, number: int):
        """Broadcast of a block and a function that gives its index within a worker."""
        rows = self.table.where(self._block() == number).drop("bytes").toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        share = self.context.broadcast(sink.getvalue().to_pybytes())
        version, width, threshold = uuid.uuid4().hex, self.width, self.threshold

        def index() -> Index:
            return per_worker("decontaminate", lambda: Index(pa.ipc.open_stream(share.value).read_all(), width, threshold), version)

        return share, index


def _hits(docs: DataFrame, blocks: Blocks) -> list[DataFrame]:
    """Staged rows (doc_id, mark, item_ids, containment) of the documents that hold an item, per block."""
    parts = []
    for number in range(blocks.number):
        share, index = blocks.send(number)

        def rows(ids, texts, index=index):
            block, known = index(), _WordHash()
            for i, text in zip(ids, texts):
                found = block.contained(word_runs(text), known)
                if found:
                    yield i, hashlib.md5(text).hexdigest(), [x for x, _ in found], [s for _, s in found]

        parts.append(stage(map_texts(docs, "doc_id long, mark string, item_ids array<long>, containment array<double>", rows, binary=True).distinct()))
        share.destroy()
    return parts


def _mark():
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def find_items(
    docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (doc_id, contaminated, item_ids, containment) of every row of ``docs``.

    ``item_ids`` lists the items held, ``containment`` their shares in the same order.
    """
    blocks = Blocks(benchmark, width, threshold, block_bytes)
    if blocks.number == 1:
        _, index = blocks.send(0)

        def rows(ids, texts):
            block, known = index(), _WordHash()
            for i, text in zip(ids, texts):
                found = block.contained(word_runs(text), known)
                yield i, bool(found), [x for x, _ in found], [s for _, s in found]

        return map_texts(docs, "doc_id long, contaminated boolean, item_ids array<long>, containment array<double>", rows, binary=True)
    parts = [part.withColumn("block", F.lit(k)) for k, part in enumerate(_hits(docs, blocks))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # A document holds each item once, whatever the number of blocks.
    zipped = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("item_ids", "containment"))))
    found = stage(every.groupBy(F.col("doc_id").alias("found_id"), F.col("mark").alias("found_mark")).agg(zipped.alias("z")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"))
    joined = base.join(broadcast_if_small(found), F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark")), "left")
    return joined.select(
        "doc_id", F.col("z").isNotNull().alias("contaminated"),
        F.coalesce("z.item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("z.containment", F.array().cast("array<double>")).alias("containment"),
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of ``docs`` that hold no item, all columns."""
    blocks = Blocks(benchmark, width, threshold, block_bytes)
    if blocks.number == 1:
        _, index = blocks.send(0)

        def keep(texts):
            block, known = index(), _WordHash()
            return [not block.contained(word_runs(t), known) for t in texts]

        return filter_texts(docs, keep)
    parts = [part.select("mark") for part in _hits(docs.select(F.lit(0).cast("long").alias("doc_id"), "text"), blocks)]
    marks = parts[0]
    for part in parts[1:]:
        marks = marks.unionByName(part)
    gone = broadcast_if_small(stage(marks.distinct()))
    return docs.join(gone, _mark() == gone["mark"], "left_anti")
