"""Token counts that follow edits.

For each document the pre-tokens of a byte-level BPE are the leaves of a segment tree: their
lengths in characters and in tokens, summed upwards. An edit (start, stop, replacement) finds its
leaves by descending the tree, re-reads from a leaf before the change until the new pre-tokens
meet an old boundary again, encodes only those, and updates the sums of the subtrees above. The
pattern reads left to right and looks at most two characters past a match, so a pre-token that
ends two characters before the change stays, and once a boundary is met behind the change all
that follows stays too. Sums are therefore those of encoding the edited text afresh.

Leaves and their text are kept in blocks of about ``BLOCK`` pre-tokens, the tree stands over the blocks, and an edit
replaces the leaves and the text of the blocks that it touches. So an edit costs the same in a text of any length.

Edge cases: a null text is empty and has no tokens; edits of a document are given in positions of
its original text, sorted and not overlapping (later ones of an overlap are passed over, ones outside
the text are cut to it); null starts, stops or replacements count as 0, the start, and empty; repeated
rows are returned as often as they occur; an empty table gives no row. Other columns aren't read.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newsloom.llm.common import per_worker

TOKENIZER = "byte_bpe_50k.json"
BLOCK = 64
CACHE = 800_000
#: The vocabulary's own pre-token pattern (fixed value).
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the query redacts: mail addresses, and numbers of four or more digits with their separators.
PRIVATE = r"[\w.+-]+@[\w-]+\.[\w.]+|\+?\d[\d ().-]{2,}\d"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Tokens of pre-tokens, remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker per core
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.pattern = regex.compile(PRE_TOKEN)
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        new = [p for p in dict.fromkeys(parts) if p not in known]
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(dict.fromkeys(parts))
            for at in range(0, len(new), 8192):
                some = new[at: at + 8192]
                known.update(zip(some, map(len, self.model.encode_batch_fast(some, add_special_tokens=False))))
        return [known[p] for p in parts]


class Tree:
    """Segment tree over blocks of pre-tokens: characters and tokens below every node."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        parts = counter.pattern.findall(text)
        self.encoded = 0
        self.blocks = self._cut(parts, counter.counts(parts)) or [([], [], "")]
        self._plant()

    @staticmethod
    def _cut(parts: list[str], tokens: list[int]) -> list[tuple[list[int], list[int], str]]:
        """Blocks (characters and tokens of the leaves, their text)."""
        return [
            (list(map(len, parts[i: i + BLOCK])), tokens[i: i + BLOCK], "".join(parts[i: i + BLOCK])) for i in range(0, len(parts), BLOCK)
        ]

    def _plant(self) -> None:
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        chars, tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (_, t, text) in enumerate(self.blocks, self.width):
            chars[i], tokens[i] = len(text), sum(t)
        for i in range(self.width - 1, 0, -1):
            chars[i], tokens[i] = chars[2 * i] + chars[2 * i + 1], tokens[2 * i] + tokens[2 * i + 1]
        self.chars, self.tokens = chars, tokens

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(text for _, _, text in self.blocks)

    def _block_at(self, place: int) -> tuple[int, int]:
        """Block that holds a character (the last one past the end), and its first character."""
        node, first = 1, 0
        while node < self.width:
            node *= 2
            if place >= first + self.chars[node] and node - self.width + 1 < len(self.blocks) * 2 and self.chars[node + 1]:
                first += self.chars[node]
                node += 1
        return node - self.width, first

    def _set(self, block: int, sizes: list[int], tokens: list[int], text: str) -> None:
        self.blocks[block] = (sizes, tokens, text)
        i = block + self.width
        self.chars[i], self.tokens[i] = len(text), sum(tokens)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start to stop - 1 of the present text."""
        old_length, shift = self.chars[1], len(new) - (stop - start)
        # The first pre-token that ends at start - 1 or later is read again.
        block, first = self._block_at(max(0, start - 2))
        sizes, tokens, before = self.blocks[block]
        keep, at = 0, first
        while keep < len(sizes) and at + sizes[keep] < start - 1:
            at += sizes[keep]
            keep += 1
        # Old boundaries and text from there on, block by block.
        last, known_to, bounds = block - 1, first, {}

        def next_block() -> str:
            nonlocal last, known_to
            last += 1
            for k, b in enumerate(accumulate(self.blocks[last][0], initial=known_to)):
                bounds[b] = (last, k)
            known_to += len(self.blocks[last][2])
            return self.blocks[last][2]

        pieces = [next_block()]
        while known_to < stop and last + 1 < len(self.blocks):
            pieces.append(next_block())
        # The window is the edited text from character ``first`` to the end of the blocks read.
        window = "".join(pieces)
        window = window[: start - first] + new + window[stop - first:]
        place, fresh, step = at - first, [], 1
        while True:
            old = first + place - shift
            if first + place >= start + len(new) and old >= stop and (old in bounds or old >= old_length):
                break
            found = self.counter.pattern.match(window, place)
            # A match is final when two characters behind it are known, or the text ends.
            while (found is None or found.end() + 2 > len(window)) and last + 1 < len(self.blocks):
                window += "".join(next_block() for _ in range(min(step, len(self.blocks) - last - 1)))
                step *= 2
                found = self.counter.pattern.match(window, place)
            fresh.append(found.group())
            place = found.end()
        end_block, end_at = bounds.get(old, (len(self.blocks) - 1, len(self.blocks[-1][0])))
        self.encoded += len(fresh)
        counted = self.counter.counts(fresh)
        tail_sizes, tail_tokens, tail = self.blocks[end_block]
        tail = tail[sum(tail_sizes[:end_at]):]
        merged_sizes = sizes[:keep] + list(map(len, fresh)) + tail_sizes[end_at:]
        merged_tokens = tokens[:keep] + counted + tail_tokens[end_at:]
        merged = before[: at - first] + "".join(fresh) + tail
        if len(merged_sizes) > 8 * BLOCK:
            # A long insertion: its leaves get blocks of their own.
            ends = list(accumulate(merged_sizes, initial=0))
            parts = [merged[a:b] for a, b in zip(ends, ends[1:])]
            self.blocks[block: end_block + 1] = self._cut(parts, merged_tokens)
            self._plant()
            return
        self._set(block, merged_sizes, merged_tokens, merged)
        for b in range(block + 1, end_block + 1):
            self._set(b, [], [], "")


def count_edits(docs: DataFrame, edits: Column, *, relative: bool = False, path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, n_edits, n_tokens_after, n_encoded, n_pretokens) of ``docs``.

    ``edits`` is an array<struct<start, stop, replacement>> in characters of the text, in order;
    ``relative`` ones count from the stop of the edit before.
    ``n_encoded`` counts the pre-tokens encoded for the edits, of ``n_pretokens`` in the document.
    """
    path = path or tokenizer_path()
    schema = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_encoded long, n_pretokens long"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        counter = per_worker(f"token counts {path}", lambda: Counter(path))
        for batch in batches:
            made = []
            for i, text, changes in zip(*(c.to_pylist() for c in batch.columns)):
                tree = Tree(text or "", counter)
                before, leaves = tree.total, sum(len(s) for s, _, _ in tree.blocks)
                shift, done, n = 0, 0, 0
                for change in changes or []:
                    base = done if relative else 0
                    a = min(max(0, base + (change["start"] or 0)), len(text or ""))
                    b = a if change["stop"] is None else min(max(a, base + change["stop"]), len(text or ""))
                    if a < done:
                        continue
                    new = change["replacement"] or ""
                    tree.edit(a + shift, b + shift, new)
                    shift, done, n = shift + len(new) - (b - a), b, n + 1
                made.append((i, before, n, tree.total, tree.encoded, leaves))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*made) if made else [[]] * len(out), out)], schema=out
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), edits.alias("edits")).mapInArrow(run, schema)


def redactions(text: str = "text", pattern: str = PRIVATE, replacement: str = "<redacted>") -> Column:
    """Relative edits that replace every match of ``pattern``."""
    split, found = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    edits = F.zip_with(split, found, lambda gap, match: F.struct(
        F.length(gap).alias("start"), (F.length(gap) + F.length(match)).alias("stop"), F.lit(replacement).alias("replacement"),
    ))
    # What follows the last match is no edit.
    return F.filter(edits, lambda e: e["stop"].isNotNull())
