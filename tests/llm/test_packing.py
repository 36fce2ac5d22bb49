import zlib

import numpy as np
import pytest
from rows import EDGES, documents
from tokenizers import Tokenizer

from newsloom.llm import packing


@pytest.fixture(scope="module")
def encode():
    model = Tokenizer.from_file(packing.tokenizer_path())
    return lambda text: model.encode(text or "", add_special_tokens=False).ids + [1]


ODD = [
    (20, "Don't STOP <|startoftext|> now <|STARTOFTEXT|>"), (21, "ΟΔΟΣ ΣΑΣ İstanbul"), (22, "a\x1cb x\x85y a b"),
    (23, "á ́b ½ ²x_y 12ab ’quoted’ “so”"), (24, "中文字 한국어 ไทย"), (25, "word " * 9000), (26, "ẞ ﬁ Ⅷ é"),
]


def test_ids_are_the_tokenizers(spark, encode):
    rows = EDGES + ODD
    got = packing.pieces(documents(spark, rows)).collect()
    want = []
    for i, text in rows:
        ids = np.array(encode(text), "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at: at + 4096]
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    order = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by


def test_sequences_are_gapless_and_few(spark):
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(1, 900, 3000), np.full(100, 4096)])
    pieces = spark.createDataFrame([(int(i), 0, 0, int(n), 7) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, group=1000).collect()
    assert len(got) == len(sizes)
    by = check_layout(got, 4096)
    assert len(by) <= sizes.sum() / 4096 * 1.01 + 4


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_every_constraint_holds(rule):
    rng = np.random.default_rng(2)
    length = np.sort(rng.integers(1, 600, 800))[::-1].astype(float)
    needs = np.stack([length, np.ones(800), length**2], 1)
    limits = np.array([1024.0, 5.0, 400_000.0])
    bins = packing.best_fit(needs, limits, np.array([1.0, 0.3, 0.3]), rule=rule)
    sums = np.zeros((bins.max() + 1, 3))
    np.add.at(sums, bins, needs)
    assert (sums <= limits).all() and sorted(set(bins)) == list(range(bins.max() + 1))


def test_empty_table_and_repeated_rows(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0
    got = packing.pack_documents(documents(spark, EDGES)).collect()
    check_layout(got, 4096)
    assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i, _ in EDGES)
    assert len({r.sequence_id for r in got}) == 1
