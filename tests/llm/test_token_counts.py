import random
import time

import pytest
from rows import EDGES, documents
from pyspark.sql import functions as F

from newsloom.llm import token_counts as C


@pytest.fixture(scope="module")
def counter():
    return C.Counter(C.tokenizer_path())


def fresh(counter, text):
    return len(counter.model.encode(text, add_special_tokens=False).ids)


def some_text(rng, n):
    return "".join(rng.choices(["word", "'", "'ll", "s", " ", "  ", "\n", "\n\n ", "12", "!?", "é", "中", "\t", "<|endoftext|>", "x", " the"], k=n))


@pytest.mark.parametrize("seed", range(12))
def test_edits_give_the_counts_of_a_fresh_encoding(counter, seed, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", [4, 64][seed % 2])
    rng = random.Random(seed)
    text = some_text(rng, rng.choice([0, 1, 5, 60, 600]))
    tree = C.Tree(text, counter)
    assert tree.total == fresh(counter, text)
    for _ in range(40):
        a = rng.randrange(len(text) + 1)
        b = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 40, 500]))
        new = some_text(rng, rng.choice([0, 0, 1, 2, 10, 300]))
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        assert tree.text == text and tree.total == fresh(counter, text)
        assert sum(sum(s) for s, _, _ in tree.blocks) == len(text) == tree.chars[1]
        assert all(sum(s) == len(t) for s, _, t in tree.blocks)


def test_a_small_edit_encodes_little(counter):
    tree = C.Tree("some plain words and more of them " * 2000, counter)
    tree.edit(30_000, 30_004, "other")
    assert 0 < tree.encoded < 10


def test_many_edits_of_a_long_text(spark, counter):
    text = "write to 12345 now " * 100_000
    began = time.monotonic()
    (row,) = C.count_edits(documents(spark, [(1, text)]), C.redactions(), relative=True).collect()
    assert time.monotonic() - began < 60
    assert row.n_edits == 100_000 and row.n_tokens_after == fresh(counter, text.replace("12345", "<redacted>"))


def test_redactions_of_documents(spark, counter):
    import re

    rows = EDGES + [(30, "Write to a.b@mail.example or +49 170 1234567, now."), (31, "no 12 or 345 here"), (32, "1234 5678 x@y.de 99999")]
    got = C.count_edits(documents(spark, rows), C.redactions(), relative=True).collect()
    want = []
    for i, text in rows:
        text = text or ""
        new, n = re.subn(C.PRIVATE, "<redacted>", text)
        want.append((i, fresh(counter, text), n, fresh(counter, new)))
    order = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted(((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in got), key=order) == sorted(want, key=order)
    assert max(r.n_edits for r in got) == 3 and C.count_edits(documents(spark, []), C.redactions(), relative=True).count() == 0


def test_odd_edits(spark, counter):
    docs = documents(spark, [(1, "abc def ghi")])
    edits = F.array(*[
        F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("stop"), F.lit(r).cast("string").alias("replacement"))
        for a, b, r in [(None, 3, "x"), (2, 5, "overlaps"), (4, None, None), (8, 99, "end")]
    ])
    (row,) = C.count_edits(docs, edits).collect()
    assert row.n_edits == 3 and row.n_tokens_after == fresh(counter, "x def end")
