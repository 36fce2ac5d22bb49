"""Token ids of a corpus as binary files with Elias-Fano coded document boundaries.

A corpus is a folder of shards and a manifest. A shard is a range of documents in ascending order of
their ids: ``<shard>.bin`` holds the ids of its documents one after another, each id in as few bytes
as the vocabulary needs (2 or 4, little-endian), so that a trainer can map it into memory;
``<shard>.idx`` holds the boundaries of the documents and their ids, both as Elias-Fano sequences. The
manifest (JSON lines) has a row per shard: file, documents, tokens, and the tokens of all shards before.

Texts are encoded where they are read; what travels are the packed ids, dealt by ranges of document id
and sorted inside each. A task streams one shard and keeps its documents' lengths and ids only, 16
bytes a document. A shard is written under the name of its attempt and renamed when whole, and it is
the same whichever attempt wins, so a lost executor costs that shard. Files go through Arrow's file
systems (local, HDFS, S3, GCS) below the folder given, by default in the cluster's shared folder.

Edge cases: a null or empty text has only the end id; documents of one id stand in the order of a hash
of their ids, repeated rows as often as they occur; null document ids come first; an empty table makes a
manifest without shards and no row; columns other than the id and text aren't read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import per_worker, shared_dir, stage, text_chunks, unstage
from newsloom.llm.elias_fano import EliasFano
from newsloom.llm.word_ids import WordIds, tokenizer_path

END_ID = 1
#: Tokens of a shard, about; a large corpus takes more.
SHARD_TOKENS = 1 << 24
#: Tokens that a reader holds at a time, if no single document has more.
WINDOW_TOKENS = 1 << 20
MAGIC = b"EFTOKEN1"
_HEAD = "<8sQQqQ"  # magic, bytes of an id, documents, smallest document id, documents without id
_MANIFEST = "shard string, n_docs long, n_tokens long, first_id long, first_tie long"


def file_system(uri: str):
    """Arrow's file system of a folder named as Hadoop names it, and the folder's path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


def encode(docs: DataFrame, *, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n, width, ids): the packed ids of each document, ``width`` bytes each."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(f"word ids {path}", lambda: WordIds(path))
        for keys, texts in text_chunks(batches):
            ids, bounds = coder(texts, end_id)
            data = pa.py_buffer(ids.astype(f"<u{coder.width}"))
            offsets = pa.array((bounds * coder.width).astype(np.int32)).buffers()[1]
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.diff(bounds)), pa.array(np.full(n, coder.width, np.int32)), pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, data])],
                ["doc_id", "n", "width", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, width int, ids binary")


class _Shard:
    """One shard while it is written."""

    def __init__(self, folder: str, name: str, attempt: str, width: int):
        self.fs, self.folder = file_system(folder)
        self.name, self.width = name, width
        self.temporary = f"{self.folder}/_{name}-{attempt}"
        self.out = self.fs.open_output_stream(f"{self.temporary}.bin")
        self.keys, self.sizes = [], []

    def add(self, batch: pa.RecordBatch) -> None:
        column = batch.column("ids").cast(pa.binary())
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
        self.out.write(column.buffers()[2][int(offsets[0]): int(offsets[-1])])
        self.sizes.append(np.diff(offsets) // self.width)
        self.keys.append(batch.column("doc_id"))

    def _index(self) -> bytes:
        keys = pa.chunked_array(self.keys)
        known = keys.drop_null().to_numpy().astype(np.int64)
        least = int(known[0]) if len(known) else 0
        head = struct.pack(_HEAD, MAGIC, self.width, len(keys), least, keys.null_count)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))])
        # Differences of 64-bit ids may need all 64 bits.
        spread = known.view(np.uint64) - np.uint64(least & (1 << 64) - 1)
        return head + EliasFano.encode(bounds).to_bytes() + EliasFano.encode(spread).to_bytes()

    def close(self) -> None:
        self.out.close()
        with self.fs.open_output_stream(f"{self.temporary}.idx") as out:
            out.write(self._index())
        for end in ("bin", "idx"):
            target = f"{self.folder}/{self.name}.{end}"
            try:
                self.fs.move(f"{self.temporary}.{end}", target)
            except OSError:  # some file systems don't replace; another attempt's file is the same
                self.fs.delete_file(target)
                self.fs.move(f"{self.temporary}.{end}", target)


def write_tokens(docs: DataFrame, folder: str | None = None, *, shard_tokens: int = SHARD_TOKENS, **options) -> str:
    """Encode ``docs`` into a corpus folder and return it; ``options`` are those of ``encode``."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/newsloom/tokens-{uuid.uuid4().hex}"
    file_system_, path = file_system(folder)
    file_system_.create_dir(path, recursive=True)
    # Beside it lie the shuffled ids and the shards, so it is kept small.
    encoded = stage(encode(docs, **options), compression="zstd")
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, n, tokens, first = TaskContext.get(), None, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if shard is None:
                first = batch.column("doc_id")[0].as_py(), batch.column("tie")[0].as_py()
                shard = _Shard(folder, f"shard-{task.partitionId():05d}", str(task.taskAttemptId()), batch.column("width")[0].as_py())
            shard.add(batch)
            n, tokens = n + batch.num_rows, tokens + sum(batch.column("n").to_pylist())
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard.name, "n_docs": n, "n_tokens": tokens, "first_id": first[0], "first_tie": first[1]}],
                schema=pa.schema([("shard", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_tokens", "first_id", "first_tie"))]),
            )

    ordered = encoded.withColumn("tie", F.xxhash64("ids")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    written = stage(ordered.mapInArrow(write, _MANIFEST))
    # A row per shard. The ranges don't overlap, so their first documents put them in order.
    rows = sorted(written.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_tie))
    unstage(encoded)
    start, lines = 0, []
    for r in rows:
        lines.append(json.dumps({"shard": r.shard, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "start": start}))
        start += r.n_tokens
    with file_system_.open_output_stream(f"{path}/manifest.json") as out:
        out.write("".join(f"{x}\n" for x in lines).encode())
    return folder


class TokenFile:
    """Random access to a shard: ``doc(i)`` is the ids of its i-th document."""

    def __init__(self, folder: str, shard: str):
        fs, path = file_system(folder)
        with fs.open_input_stream(f"{path}/{shard}.idx") as source:
            data = source.read()
        magic, self.width, self.n_docs, self.least, self.without_id = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError(f"{shard}.idx is no index of token ids")
        self.bounds, at = EliasFano.from_bytes(data, struct.calcsize(_HEAD))
        self.spread, _ = EliasFano.from_bytes(data, at)
        self.ids = fs.open_input_file(f"{path}/{shard}.bin")

    def starts(self, index) -> np.ndarray:
        """Tokens of the shard before the given documents; ``n_docs`` gives all."""
        return self.bounds.select(index).astype(np.int64)

    def doc_ids(self, first: int, end: int) -> pa.Array:
        known = np.arange(max(first, self.without_id), end) - self.without_id
        values = (self.spread.select(known) + np.uint64(self.least & (1 << 64) - 1)).view(np.int64)
        return pa.concat_arrays([pa.nulls(end - first - len(known), pa.int64()), pa.array(values)])

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids from token ``start`` to before token ``end``."""
        return np.frombuffer(self.ids.read_at((end - start) * self.width, start * self.width), f"<u{self.width}").astype("<u4")

    def doc(self, i: int) -> np.ndarray:
        return self.read(*self.starts([i, i + 1]).tolist())

    def windows(self, most: int = WINDOW_TOKENS, docs: int = 1 << 16):
        """(first document, bounds) of runs of whole documents, in bounded pieces."""
        for at in range(0, self.n_docs, docs):
            bounds = self.starts(np.arange(at, min(at + docs, self.n_docs) + 1))
            a = 0
            while a < len(bounds) - 1:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1)
                yield at + a, bounds[a: b + 1]
                a = b


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read from a corpus folder, a task per shard.

    ``with_ids`` adds the ids as unsigned 32-bit little-endian bytes.
    """
    fs, path = file_system(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as source:
        shards = [json.loads(x) for x in source.read().decode().splitlines()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = TokenFile(folder, row["shard"])
                for first, bounds in shard.windows():
                    data = memoryview(shard.read(int(bounds[0]), int(bounds[-1])).tobytes())
                    cuts = ((bounds - bounds[0]) * 4).tolist()
                    parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
                    out = {
                        "doc_id": shard.doc_ids(first, first + len(parts)), "start": pa.array(bounds[:-1] + row["start"]),
                        "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([bytes(x) for x in parts], pa.binary())
                    yield pa.RecordBatch.from_pydict(out)

    listed = spark.createDataFrame([(x["shard"], x["start"]) for x in shards], "shard string, start long")
    dealt = listed.repartition(max(1, len(shards)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return dealt.mapInArrow(run, schema)
