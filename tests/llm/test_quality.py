import os

import numpy as np
import pytest
from rows import EDGES, documents, held_out

from newsloom.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_gradient_lowers_the_loss_and_attention_finds_the_bad_passage():
    rng = np.random.default_rng(0)
    bags, ys, bad = [], [], []
    for i in range(200):
        x = rng.normal(0, 1, (rng.integers(1, 8), 5))
        y = i % 2
        at = rng.integers(len(x))
        x[:, 0] = 0
        if not y:
            x[at, 0] = 3
        bags.append(x)
        ys.append(y)
        bad.append(at)
    first = np.cumsum([0] + [len(b) for b in bags[:-1]])
    w = Q.train(np.concatenate(bags), first, np.array(ys, float), steps=200)
    *_, attention, size, _, logit = Q._forward(np.concatenate(bags), first, w)
    assert np.mean((logit > 0) == np.array(ys)) > 0.97
    found = [attention[a: a + n].argmax() == at for a, n, at, y in zip(first, size, bad, ys) if not y and n > 1]
    assert np.mean(found) > 0.9
    np.testing.assert_allclose(np.add.reduceat(attention, first), 1)


def test_passages_cover_the_whole_text():
    words = [f"w{i}".encode() for i in range(1000)]
    assert len(Q.bag(b" ".join(words))) == -(-1000 // Q.PASSAGE)
    assert len(Q.bag(b" ".join(words), 3)) == 3 and Q.bag(b"").shape == (1, Q.WIDTH) and not Q.bag(b" \n").any()


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_edge_rows_and_held_out_labels(spark):
    rows = [(100 + i, "Fine words make a good text. " * 30 if i % 2 else "BAD!! BAD!! $$$ ### " * 30) for i in range(120)]
    docs = documents(spark, rows + EDGES)
    labels = [(i, i % 2, 0) for i, _ in rows] + [(5, None, 1), (None, 1, 1)]
    flipped = [(i, None if q is None else 1 - q, t) if held_out(i, 5, 0) else (i, q, t) for i, q, t in labels]
    got = Q.quality(docs, labelled(spark, labels)).collect()
    again = Q.quality(docs, labelled(spark, flipped)).collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    assert [(r.doc_id, r.score) for r in sorted(got, key=order)] == [(r.doc_id, r.score) for r in sorted(again, key=order)]
    assert len(got) == len(rows) + len(EDGES)
    for r in got:
        assert r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert abs(sum(r.attention) - 1) < 1e-4
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.predicted == r.doc_id % 2
    model = Q.fit(docs, labelled(spark, labels))
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in got if r.predicted)


def test_without_labels(spark):
    assert {r.score for r in Q.quality(documents(spark, EDGES), labelled(spark, [])).collect()} == {0.5}
    assert Q.quality(documents(spark, []), labelled(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in Q.quality(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert len(got) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95
