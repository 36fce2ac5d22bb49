"""Token ids of texts by a lower-casing BPE tokenizer with word ends, many texts at a time.

Texts are lower-cased and cut at blanks by Arrow, and each distinct word of a chunk is looked up
once; only words that the worker hasn't seen go to the tokenizer. Texts in which Arrow and the
tokenizer may disagree about letter case, composition or blanks are encoded whole, so that ids are
the tokenizer's own in every case.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
#: Words and their characters that a worker remembers; beyond either only those met in several chunks stay.
MOST_WORDS, MOST_CHARS = 250_000, 8 << 20
#: Characters of new words that go to the tokenizer at a time, about: an encoding takes many times the memory of its text.
LEARN_CHARS = 1 << 16
#: The tokenizer's own pre-token pattern (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Beyond Latin and general punctuation, lower case, white space or composed letters may be something
#: else to Arrow than to the tokenizer. What is left has no combining marks, so it is in NFC.
OTHER = "[^\\x09-\\x0d\\x20-\\x7e\\xa0-\\u012f\\u0131-\\u024f\\u2010-\\u2027\\u2030-\\u205e]"
#: Start of the tokenizer's special strings, which it finds before it lower-cases.
SPECIAL = "<|"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every (start, size), one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


class WordIds:
    def __init__(self, path: str, most_words: int = MOST_WORDS, most_chars: int = MOST_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker per core
        import regex
        from tokenizers import Tokenizer, normalizers

        self.whole, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])  # words come lower-cased
        self.split = regex.compile(PRE_TOKEN).findall
        self.other = re.compile(OTHER).search
        vocabulary = self.whole.get_vocab()
        #: Bytes that hold any id.
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.limits = most_words, most_chars
        self.place: dict[str, int] = {}
        self.chars = self.used = 0
        self.store = np.zeros(0, "<u4")
        self.start = self.size = self.met = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the words met in most chunks, half of the memory at most, and none met once only."""
        words, most, room = list(self.place), self.limits[0] // 2, self.limits[1] // 2
        met = self.met[: len(words)]
        best = np.argsort(-met, kind="stable")[: np.count_nonzero(met > 1)][:most]
        best = best[np.cumsum([len(words[i]) for i in best]) <= room]
        ids = self.store[spans(self.start[best], self.size[best])]
        self.size, self.met = self.size[best], np.ones(len(best), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.store, self.used = ids, len(ids)
        self.place = {words[i]: k for k, i in enumerate(best)}
        self.chars = sum(map(len, self.place))

    @staticmethod
    def _ids(model, text: str) -> np.ndarray:
        return np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def _parts(words: list[str]) -> Iterator[list[str]]:
        """``words`` in parts of at most ``LEARN_CHARS`` characters, or of one word."""
        start = chars = 0
        for end, word in enumerate(words):
            if chars + len(word) > LEARN_CHARS and end > start:
                yield words[start:end]
                start, chars = end, 0
            chars += len(word)
        if words:
            yield words[start:]

    def _learn(self, words: list[str]) -> None:
        ids = self._ids(self.words, " ".join(words))
        stops = np.flatnonzero(self.ends[ids]) + 1  # the last id of every pre-token
        counts = np.cumsum([len(self.split(w)) for w in words])
        if len(stops) == counts[-1]:
            bounds = np.concatenate([[0], np.concatenate([[0], stops])[counts]])
        else:
            parts = [self._ids(self.words, w) for w in words]
            ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        n, had = len(words), len(self.place)
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(max(len(ids), self.used), "<u4")])
        if had + n > len(self.start):
            more = np.zeros(max(n, had), np.int64)
            self.start, self.size, self.met = (np.concatenate([x[:had], more]) for x in (self.start, self.size, self.met))
        self.store[self.used: self.used + len(ids)] = ids
        self.start[had: had + n] = bounds[:-1] + self.used
        self.size[had: had + n] = np.diff(bounds)
        self.place.update(zip(words, range(had, had + n)))
        self.used += len(ids)
        self.chars += sum(map(len, words))

    def __call__(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null as empty), each with ``end_id`` behind it, and the n + 1 bounds of the texts."""
        if len(self.place) > self.limits[0] or self.chars > self.limits[1]:
            self._forget()
        odd = {i: self._ids(self.whole, t) for i, t in enumerate(texts.to_pylist()) if t and (SPECIAL in t or self.other(t))}
        if odd:
            texts = pc.if_else(pa.array([i in odd for i in range(len(texts))]), pa.scalar("", texts.type), texts)
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.place]
        for part in self._parts(new):
            self._learn(part)
        known = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        self.met[known] += 1
        words = known[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        sizes = self.size[words]
        offsets = split.offsets.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes)])[offsets - offsets[0]]
        ids = self.store[spans(self.start[words], sizes)]
        if odd:
            parts, extra, last = [], np.zeros(len(bounds), np.int64), 0
            for i, own in odd.items():
                parts += [ids[last: bounds[i]], own]
                extra[i + 1] = len(own)
                last = bounds[i]
            ids, bounds = np.concatenate([*parts, ids[last:]]), bounds + np.cumsum(extra)
        if end_id is None:
            return ids, bounds
        bounds = bounds + np.arange(len(bounds))
        out = np.full(bounds[-1], end_id, "<u4")
        own = np.ones(len(out), bool)
        own[bounds[1:] - 1] = False
        out[own] = ids
        return out, bounds
