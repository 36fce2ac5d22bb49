import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import EDGES, documents
from tokenizers import Tokenizer

from newsloom.llm import alignment as A
from newsloom.llm.word_ids import tokenizer_path


class Plain:
    """Whole texts by both tokenizers, aligned by sets of ends."""

    def __init__(self):
        self.a = Tokenizer.from_file(tokenizer_path(A.A_FILE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(A.B_FILE))
        code = A.byte_level()
        self.a_bytes = {i: bytes(code[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in code for c in t)}

    def tokens(self, text):
        """Ids and ends of both, or None."""
        if not text:
            return None
        own = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x = [self.a_bytes[i] for i in a]
        y = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(x) != own or b"".join(y) != own:
            return None
        ends = [[sum(map(len, t[: k + 1])) for k in range(len(t))] for t in (x, y)]
        return a, ends[0], b, ends[1]

    def groups(self, text):
        a, ae, b, be = self.tokens(text)
        out, p, r = [], 0, 0
        for end in sorted(set(ae) & set(be)):
            q, s = ae.index(end) + 1, be.index(end) + 1
            out.append((a[p:q], b[r:s]))
            p, r = q, s
        return out

    def links(self, text):
        a, ae, b, be = self.tokens(text)
        first = lambda e, k: e[k - 1] if k else 0
        return [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if first(ae, i) < be[j] and first(be, j) < ae[i]]

    def table(self, rows):
        held = [self.links(t) if self.tokens(t) else [] for _, t in rows]
        count = Counter(p for x in held for p in set(x))
        best = {}
        for (a, _), n in count.items():
            best[a] = max(best.get(a, 0), n)
        out = []
        for (i, text), links in zip(rows, held):
            found = self.tokens(text)
            if not found:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            groups = self.groups(text)
            shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            out.append((
                i, len(found[0]), len(found[2]), len(groups), len(links), sum(count[p] == best[p[0]] for p in links),
                sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest(),
            ))
        return out


PLAIN = Plain()
ALIGNER = A.Aligner(tokenizer_path(A.A_FILE), tokenizer_path(A.B_FILE), most_parts=30)
SCORER = A.Aligner(tokenizer_path(A.A_FILE), tokenizer_path(A.B_FILE), pairs=tuple(np.zeros(0, np.int64) for _ in range(3)), most_parts=30)
ORDER = lambda r: (r[0] is None, r[0] or 0, *r[1:])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aT's é\n\t ▁\x1c\x85\xa0　<|>中1½.,_") | st.characters(codec="utf-8"), max_size=25))
def test_parts_are_aligned_as_whole_texts(text):
    parts, bounds, good = ALIGNER(pa.array([text, None, "x  y " + text]))
    for k, whole in enumerate([text, None, "x  y " + text]):
        assert bool(good[k]) == (PLAIN.tokens(whole) is not None)
        if good[k]:
            own = parts[bounds[k]: bounds[k + 1]]
            want = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in PLAIN.groups(whole))
            assert b";".join(SCORER.groups[i] for i in SCORER(pa.array([whole]))[0]).decode() == want
            assert ALIGNER.figures[own, 3].sum() == len(PLAIN.links(whole))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.randoms(use_true_random=False))
def test_groups_end_at_every_shared_end(n, rng):
    a, b = ([*sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n] for _ in range(2))
    found = A.align(a, b)
    assert [a[q - 1] for _, q, _, _ in found] == sorted(set(a) & set(b)) == [b[s - 1] for *_, s in found]
    assert [x for p, q, _, _ in found for x in a[p:q]] == a and [x for *_, r, s in found for x in b[r:s]] == b


@pytest.mark.parametrize("long", [3, 256])
def test_many_texts_side_by_side(monkeypatch, long):
    monkeypatch.setattr(A, "LONG", long)
    rng = random.Random(long)
    a, b, sizes, want = [], [], [[0], [0]], ([], [])
    for k in range(200):
        n = rng.randint(1, 30)
        x, y = ([*sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n] for _ in range(2))
        for p, q, r, s in A.align(x, y):
            want[0].append(len(a) + q - 1)
            want[1].append(len(b) + s - 1)
        base = a[-1] if a else 0
        a += [base + e for e in x]
        b += [base + e for e in y]
        sizes[0].append(len(a))
        sizes[1].append(len(b))
    got = A.align_many(np.array(a), np.array(b), np.array(sizes[0]), np.array(sizes[1]))
    assert [g.tolist() for g in got] == list(want)


def test_long_interval_without_a_shared_end():
    n = 200_000
    assert A.align([*range(2, 2 * n, 2), 2 * n], [*range(1, 2 * n, 2), 2 * n]) == [(0, n, 0, n + 1)]


ROWS = EDGES + [
    (20, "Don't <|endoftext|> stop </s> now <0x0A>"), (21, "a ▁ b"), (22, " lead and trail "), (23, "two  blanks\n and a line\n"),
    (24, "中文字 한국어 ไทย ½"), (20, "same id"), (None, "same id"), (25, "aaaa" * 3000), (26, "tok" * 5 + " \t x"),
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = "the of tokenization alignment Straße naïve co-operate 1234 don't, end. xyzzyq".split()
    return ROWS + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(60)]


@pytest.mark.parametrize("pair_bytes", [A.PAIR_BYTES, 6000])
def test_table_equals_plain_loops(spark, rows, pair_bytes):
    got = A.align_documents(documents(spark, rows).repartition(4), pair_bytes=pair_bytes)
    assert sorted(map(tuple, got.collect()), key=ORDER) == sorted(PLAIN.table(rows), key=ORDER)


def test_pairs_leave_a_task_in_bounded_numbers(spark, rows, monkeypatch):
    docs = documents(spark, rows)
    whole = {(r.a, r.b): r.n for r in A.count_pairs(docs).collect()}
    monkeypatch.setattr(A, "MOST_PAIRS", 30)
    assert {(r.a, r.b): r.n for r in A.count_pairs(docs).collect()} == whole


def test_empty_table_and_invalid_text(spark):
    assert A.align_documents(documents(spark, [])).count() == 0
    odd = spark.sql("SELECT 1L AS doc_id, cast(X'61ff62' AS string) AS text")
    assert [tuple(r) for r in A.align_documents(odd).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
