"""Alignment of the tokens of two tokenizers over the bytes of the same text.

Tokens of A (byte-level BPE over blank + text) and of B (sentence pieces over the text, whose blank the
model adds) are laid over the same bytes. Where a token of A and one of B end together, both are cut:
``align`` looks for such an end near the middle of an interval by bisection, cuts there, and goes on with
both halves; an interval without one is a group. A pair of tokens is linked if their bytes overlap.

A blank behind a character that is no white space always starts a token of A, by its pre-token pattern,
and of B, none of whose pieces has a blank behind another character (checked when it is loaded). So
texts are cut there first; each distinct part of a chunk is encoded and aligned once per worker, and a
document's groups are those of its parts in turn.

Two passes read the texts, and nothing of a text is shuffled or staged. The first counts, for each pair
of ids, the documents that hold it linked: distinct pairs per document, added up within tasks, then over
the cluster. The second scores each document's links. The counts are sent to tasks in parts by A id, of
at most ``PAIR_BYTES`` each by their measured size; one part is usual, more take a pass each.

Edge cases: null and empty texts, and texts whose joined bytes of A or B differ from blank + text (as
with U+2581, which B reads as a blank, or invalid UTF-8), have no tokens: zeros and ''. Repeated rows are documents of their
own; an empty table gives no row; columns other than the id and text aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import os
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import per_worker, stage, text_chunks
from newsloom.llm.word_ids import OTHER, spans, tokenizer_path
from newsloom.plans.staging import measured_bytes

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of counted pairs that tasks hold at a time.
PAIR_BYTES = 64 << 20
#: Parts and their characters that a worker remembers; beyond either its memory starts anew.
MOST_PARTS, MOST_CHARS = 150_000, 8 << 20
#: Parts that go to a tokenizer in one text, and tokens from which a text is aligned by itself.
JOINED, LONG = 64, 256
#: Counted pairs that a task holds before it hands them on.
MOST_PAIRS = 1 << 21
#: A blank whose character before is white space too: no place to cut.
_INNER = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_BLANK = "▁"


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups (first and end token of A, first and end token of B) of two rising lists of token ends, whose last is the same."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        middle = (a0 + a1 - 1) // 2
        for step in range(a1 - a0 if b1 - b0 > 1 else 0):
            # The middle, then places ever farther from it, on both sides in turn.
            i = middle + (step + 1) // 2 * (1 if step % 2 else -1)
            if not a0 <= i < a1 - 1:
                continue
            j = bisect_left(b, a[i], b0, b1 - 1)
            if j < b1 - 1 and b[j] == a[i]:
                todo += [(i + 1, a1, j + 1, b1), (a0, i + 1, b0, j + 1)]
                break
        else:
            out.append((a0, a1, b0, b1))
    return out


def align_many(a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last tokens of A and of B of all groups, in order, of many texts side by side.

    ``a`` and ``b`` are the token ends of all texts on one axis, the bounds tell the texts' tokens. Halving
    goes on in all texts at once, a level at a time; a long text is worked off by itself.
    """
    a0, a1, b0, b1 = a_bounds[:-1], a_bounds[1:], b_bounds[:-1], b_bounds[1:]
    a_last, b_last = [], []
    long = a1 - a0 > LONG
    for p, q, r, t in zip(a0[long].tolist(), a1[long].tolist(), b0[long].tolist(), b1[long].tolist()):
        found = align(a[p:q].tolist(), b[r:t].tolist())
        a_last.append(p - 1 + np.array([x[1] for x in found]))
        b_last.append(r - 1 + np.array([x[3] for x in found]))
    a0, a1, b0, b1 = (x[~long & (a1 > a0)] for x in (a0, a1, b0, b1))
    while len(a0):
        middle, cut_a, cut_b = (a0 + a1 - 1) // 2, np.full(len(a0), -1), np.full(len(a0), -1)
        left, step = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1)), 0
        while len(left):
            # The middle, then places ever farther from it, on both sides in turn.
            i = middle[left] + (step + 1) // 2 * (1 if step % 2 else -1)
            inside = (i >= a0[left]) & (i < a1[left] - 1)
            end = a[np.where(inside, i, a0[left])]
            j = np.searchsorted(b, end)
            hit = inside & (j < b1[left] - 1) & (b[j] == end)
            cut_a[left[hit]], cut_b[left[hit]] = i[hit], j[hit]
            step += 1
            left = left[~hit & (step < a1[left] - a0[left])]
        none = cut_a < 0
        a_last.append(a1[none] - 1)
        b_last.append(b1[none] - 1)
        a0, a1, b0, b1, i, j = (x[~none] for x in (a0, a1, b0, b1, cut_a + 1, cut_b + 1))
        a0, a1, b0, b1 = (np.concatenate(x) for x in ((a0, i), (i, a1), (b0, j), (j, b1)))
    empty = [np.zeros(0, np.int64)]
    return np.sort(np.concatenate(a_last or empty)), np.sort(np.concatenate(b_last or empty))


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of A and of B whose byte ranges overlap, and where their overlaps end: both cut the bytes, so each stretch between two ends is one pair's."""
    ends = np.concatenate([a, b])
    ends.sort(kind="stable")  # merges two sorted runs
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return np.searchsorted(a, ends), np.searchsorted(b, ends), ends


def byte_level() -> dict[str, int]:
    """Bytes by the characters that byte-level vocabularies write for them: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Encodes and aligns parts; ``pairs`` are (codes in order, counts, whether the highest of their A id)."""

    def __init__(self, a_path: str, b_path: str, pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, most_parts: int = MOST_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        code = byte_level()
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(code[c] for c in name) if all(c in code for c in name) else name.encode()
        self.ranks, self.other = self._ranks(a_path), re.compile(OTHER).search
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(_BLANK in p.lstrip(_BLANK) for p in pieces):
            raise ValueError("a piece with an inner blank: texts can't be cut at blanks")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = pieces.index(_BLANK)
        shown = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits, self.digits_size = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown])
        self.digits_start = np.cumsum(self.digits_size) - self.digits_size
        self.a_size, self.b_size = [np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes)]
        self.pairs, self.most = pairs, most_parts
        self.place: dict[str, int] = {}
        self.chars = 0
        #: Per part: tokens of A, of B, groups, links, best links, sum of counts, 1 if its bytes differ.
        self.figures = np.zeros((0, 7), np.int64)
        self.met = self.codes = self.sizes = self.starts = np.zeros(0, np.int64)
        self.groups: list[bytes] = []

    def _ranks(self, a_path: str):
        """A's vocabulary as a rank file beside it, which another library reads much faster; None if there is none or it differs."""
        path = a_path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, lines)}
        if any(self.a_bytes[i] != x for x, i in ranks.items()):
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _a_ids(self, texts: list[str]) -> list[list[int]]:
        # Both know the same letters and blanks in these texts, so they cut them alike.
        fast = [self.ranks is not None and not self.other(t) for t in texts]
        rest = iter(self.a.encode_batch_fast([t for t, f in zip(texts, fast) if not f], add_special_tokens=False))
        return [self.ranks.encode_ordinary(t) if f else next(rest).ids for t, f in zip(texts, fast)]

    @property
    def n_b(self) -> int:
        return len(self.b_bytes)

    def _forget(self) -> None:
        """Keep the parts met in most chunks, half of the memory at most, and none met once only."""
        parts = list(self.place)
        best = np.argsort(-self.met, kind="stable")[: np.count_nonzero(self.met > 1)][: self.most // 2]
        best = best[np.cumsum([len(parts[i]) for i in best]) <= MOST_CHARS // 2]
        self.place = {parts[i]: k for k, i in enumerate(best)}
        self.chars = sum(map(len, self.place))
        self.figures, self.met = self.figures[best], np.ones(len(best), np.int64)
        if self.pairs is None:
            self.codes, self.sizes = self.codes[spans(self.starts[best], self.sizes[best])], self.sizes[best]
            self.starts = np.cumsum(self.sizes) - self.sizes
        else:
            self.groups = [self.groups[i] for i in best]

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and of B of all parts, the n + 1 bounds of both, and which parts' bytes differ; None if parts can't be told apart."""
        texts = [" ".join(parts[at: at + JOINED]) for at in range(0, len(parts), JOINED)]
        a = np.concatenate([np.array(x, np.int64) for x in self._a_ids([" " + t for t in texts])])
        b = np.concatenate([np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)])
        whole = " " + " ".join(parts)
        own = whole.encode()
        if any(b"".join([size[i] for i in ids.tolist()]) != own for ids, size in ((a, self.a_bytes), (b, self.b_bytes))):
            return None
        lengths = [len(p) + 1 for p in parts] if len(own) == len(whole) else [len(p.encode()) + 1 for p in parts]
        stops, bounds = np.cumsum(lengths), []
        for ids, size in ((a, self.a_size), (b, self.b_size)):
            ends = np.cumsum(size[ids])
            at = np.searchsorted(ends, stops)
            if (ends[at] != stops).any():
                return None
            bounds.append(np.concatenate([[0], at + 1]))
        return a, b, *bounds, np.zeros(len(parts), bool)

    def _encode_singly(self, parts: list[str]):
        a = [x.ids for x in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        # The model adds no blank to nothing.
        b = [x if p else [self.blank] for p, x in zip(parts, self.b.encode(parts, num_threads=1))]
        differ = np.zeros(len(parts), bool)
        for k, part in enumerate(parts):
            own = b" " + part.encode()
            if b"".join([self.a_bytes[i] for i in a[k]]) != own or b"".join([self.b_bytes[i] for i in b[k]]) != own:
                a[k], b[k], differ[k] = [], [], True
        return *(np.array([i for x in y for i in x], np.int64) for y in (a, b)), *(np.cumsum([0, *map(len, y)]) for y in (a, b)), differ

    def _learn(self, parts: list[str]) -> None:
        """Parts without their first blank."""
        joined = sorted((p for p in parts if p and _BLANK not in p and not p[-1].isspace()), key=lambda p: not p.isascii())
        found = self._encode(joined) if joined else None
        rest = set(joined) if found else set()
        single = [p for p in parts if p not in rest]
        if not found:
            joined, found = single, self._encode_singly(single)
        elif single:
            more = self._encode_singly(single)
            found = *(np.concatenate([x, y]) for x, y in zip(found[:2], more[:2])), *(np.concatenate([x, x[-1] + y[1:]]) for x, y in zip(found[2:4], more[2:4])), np.concatenate([found[4], more[4]])
            joined = joined + single
        self._keep(joined, *found)

    def _shown(self, a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[bytes]:
        """Each part's groups as ``a1,a2|b1;a3|b2,b3``."""
        # Tokens in the order of the text shown: a group's tokens of A, then those of B. A mark follows each.
        first_a, first_b = np.concatenate([[0], last_a + 1])[:-1], np.concatenate([[0], last_b + 1])[:-1]
        size_a, size_b = last_a + 1 - first_a, last_b + 1 - first_b
        at_b = np.cumsum(size_a + size_b) - size_b
        ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[spans(at_b - size_a, size_a)], ids[spans(at_b, size_b)] = a, b
        marks[at_b - 1], marks[at_b + size_b - 1] = ord("|"), ord(";")
        digits = self.digits_size[ids]
        ends = np.cumsum(digits + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = marks
        out[spans(ends - 1 - digits, digits)] = self.digits[spans(self.digits_start[ids], digits)]
        whole = out.tobytes()
        # A part ends before its last mark; one without tokens shows nothing.
        groups = np.searchsorted(last_a, a_bounds)
        stops = np.concatenate([[0], ends[at_b + size_b - 1]])[groups].tolist() if len(ends) else [0] * len(groups)
        return [whole[p: q - 1] if q > p else b"" for p, q in zip(stops, stops[1:])]

    def _keep(self, parts: list[str], a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray, differ: np.ndarray) -> None:
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        last_a, last_b = align_many(a_ends, b_ends, a_bounds, b_bounds)
        i, j, ends = links(a_ends, b_ends)
        codes = a[i] * self.n_b + b[j]
        figures = np.zeros((len(parts), 7), np.int64)
        figures[:, 0], figures[:, 1], figures[:, 6] = np.diff(a_bounds), np.diff(b_bounds), differ
        group_bounds = np.searchsorted(last_a, a_bounds)
        figures[:, 2] = np.diff(group_bounds)
        stops = np.concatenate([[0], a_ends])[a_bounds]
        link_bounds = np.searchsorted(ends, stops, side="right")
        sizes = np.diff(link_bounds)
        figures[:, 3] = sizes
        if self.pairs is None:
            self.codes, self.sizes = np.concatenate([self.codes, codes]), np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
        else:
            known, counts, best = self.pairs
            if len(known) and len(codes):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = known[at] == codes  # other parts of the counts have the rest
                for column, values in ((4, hit & best[at]), (5, np.where(hit, counts[at], 0))):
                    sums = np.concatenate([[0], np.cumsum(values)])
                    figures[:, column] = sums[link_bounds[1:]] - sums[link_bounds[:-1]]
            self.groups += self._shown(a, b, a_bounds, last_a, last_b)
        had = len(self.place)
        self.place.update(zip(parts, range(had, had + len(parts))))
        self.chars += sum(map(len, parts))
        self.met = np.concatenate([self.met, np.zeros(len(parts), np.int64)])
        self.figures = np.concatenate([self.figures, figures])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts of all texts as places in memory, the n + 1 bounds of the texts, and whether a text has tokens."""
        if len(self.place) > self.most or self.chars > MOST_CHARS:
            self._forget()
        own = texts.to_pylist()
        inner = [i for i, t in enumerate(own) if t and (t[0] == " " or _INNER.search(t))]
        plain = texts
        if inner:
            odd = np.zeros(len(texts), bool)
            odd[inner] = True
            plain = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts)
        split = pc.split_pattern(pc.fill_null(plain, ""), " ")
        if inner:
            # Texts cut by Arrow, then those cut here, and back to their order.
            cut = pa.array([[p[1:] for p in _CUT.split(" " + own[i])] for i in inner], split.type)
            order = np.arange(len(own))
            order[inner] = len(own) + np.arange(len(inner))
            split = pa.chunked_array([split, cut]).combine_chunks().take(pa.array(order))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.place]
        if new:
            self._learn(new)
        known = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        self.met[known] += 1
        parts = known[coded.indices.to_numpy()]
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        bad = np.concatenate([[0], np.cumsum(self.figures[parts, 6])])
        return parts, bounds, (np.diff(bad[bounds]) == 0) & np.array([bool(t) for t in own])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # Invalid UTF-8 would be no text in Python; such rows have no tokens.
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.when(F.is_valid_utf8(text), text).alias("text"), F.xxhash64(text).alias("h"))


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(codes), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def count_pairs(
    docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows (a, b, n): the documents that hold two ids linked."""
    a_path, b_path = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_worker("aligner", lambda: Aligner(a_path, b_path), f"{a_path} {b_path}")
        codes, counts, held = [], [], 0

        def rows():
            every, n = _merged(codes, counts)
            for at in range(0, len(every), 1 << 16):
                part = every[at: at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(part // aligner.n_b, pa.int32()), "b": pa.array(part % aligner.n_b, pa.int32()), "n": pa.array(n[at: at + (1 << 16)]),
                })

        for _, texts in text_chunks(batches):
            parts, bounds, good = aligner(texts)
            doc = np.repeat(np.arange(len(good)), np.diff(bounds))
            used = good[doc]
            # Distinct parts of each document, then their distinct pairs.
            both = np.unique(doc[used] * len(aligner.place) + parts[used])
            doc, parts = np.divmod(both, max(1, len(aligner.place)))
            sizes = aligner.sizes[parts]
            pairs = aligner.codes[spans(aligner.starts[parts], sizes)] if len(parts) else np.zeros(0, np.int64)
            top = len(aligner.a_bytes) * aligner.n_b
            every, n = np.unique(np.unique(np.repeat(doc, sizes) * top + pairs) % top, return_counts=True)
            codes.append(every)
            counts.append(n)
            held += len(every)
            if held > MOST_PAIRS:
                every, n = _merged(codes, counts)
                if len(every) > MOST_PAIRS // 2:
                    yield from rows()
                    codes, counts, held = [], [], 0
                else:
                    codes, counts, held = [every], [n], len(every)
        if held:
            yield from rows()

    found = _texts(docs, id_col, text_col).select("id", "text").mapInArrow(run, "a int, b int, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def align_documents(
    docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    pair_bytes: int = PAIR_BYTES,
) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per document."""
    a_path, b_path = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)
    counted = stage(count_pairs(docs, a_path=a_path, b_path=b_path, id_col=id_col, text_col=text_col))
    # An A id has at most as many pairs as B has ids.
    scored = counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))
    parts = max(1, math.ceil(measured_bytes(counted) / pair_bytes))
    texts = _texts(docs, id_col, text_col)
    passes = []
    for number in range(parts):
        rows = scored.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == number).toArrow()
        passes.append(_score(texts, rows, a_path, b_path))
    out = passes[0]
    if parts > 1:
        # Equal rows have equal figures, so one of them is enough to join.
        more = passes[0].select("doc_id", "h", "n_best", "count_sum").withColumn("p", F.lit(0))
        for number, one in enumerate(passes[1:], 1):
            more = more.unionByName(one.select("doc_id", "h", "n_best", "count_sum").withColumn("p", F.lit(number)))
        sums = more.distinct().groupBy("doc_id", "h").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        sums = sums.select(F.col("doc_id").alias("i"), F.col("h").alias("g"), "n_best", "count_sum")
        out = out.drop("n_best", "count_sum").join(sums, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _score(texts: DataFrame, rows: pa.Table, a_path: str, b_path: str) -> DataFrame:
    a, b, n = (rows[c].to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    shared = texts.sparkSession.sparkContext.broadcast((a, b, n, rows["best"].to_numpy(zero_copy_only=False).astype(bool)))
    version = uuid.uuid4().hex

    def scorer() -> Aligner:
        a, b, n, best = shared.value
        aligner = Aligner(a_path, b_path, pairs=())
        codes = a * aligner.n_b + b
        order = np.argsort(codes)
        aligner.pairs = codes[order], n[order], best[order]
        return aligner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_worker("aligner", scorer, version)
        for batch in batches:
            at = 0
            for ids, chunk in text_chunks(iter([batch.select([0, 1])])):
                parts, bounds, good = aligner(chunk)
                sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(aligner.figures[parts, :6], axis=0)])
                figures = np.where(good[:, None], sums[bounds[1:]] - sums[bounds[:-1]], 0)
                groups, held, cuts = aligner.groups, parts.tolist(), bounds.tolist()
                digests = [
                    hashlib.sha256(b";".join([groups[k] for k in held[p:q]])).hexdigest() if ok else ""
                    for ok, p, q in zip(good.tolist(), cuts, cuts[1:])
                ]
                names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
                yield pa.RecordBatch.from_arrays(
                    [ids, batch.column(2).slice(at, len(ids)), *(pa.array(figures[:, k]) for k in range(6)), pa.array(digests, pa.string())],
                    ["doc_id", "h", *names, "groups_sha256"],
                )
                at += len(ids)

    return texts.mapInArrow(
        run, "doc_id long, h long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
