import numpy as np
import pytest

from newsloom.llm import ann


def table(spark, ids, vectors):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v], 0, "r") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rank string")


def some_vectors(n=900, dim=20, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.35, (n, dim))
    x[: n // 3] = centres[0] + rng.normal(0, 1e-3, (n // 3, dim))  # a third in one place
    x[10:40] = x[10]  # equal ones
    return x


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(1))
    order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return [(int(ids[j]), d[j]) for j in order]


@pytest.mark.parametrize("chunk,hashes", [(8192, 1), (50, 1), (8192, 2)])
def test_recall_and_exact_scores(spark, monkeypatch, chunk, hashes):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    x = some_vectors()
    ids = np.arange(len(x)) * 5
    rows = table(spark, ids, x)
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 100 = 0"), hashes=hashes, probes=4 if hashes == 1 else 12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        want = brute(ids, x, q)
        exact = {i: d for i, d in brute(ids, x, q, len(ids))}
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for i, _ in want} & {i for _, i, _ in found})
        total += 10
    assert hits / total > 0.9


def test_small_and_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    ids = [0, 100, 1, 2, 3, 4, 5, 6, 7, 8, 100]
    x = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], None, [0, 0, 0], [nan, 1, 1], [inf, 0, 1], [None, 1, 2], [1, 2], [0, 1, 0]]
    rows = table(spark, ids, x)
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [2, 1, 100], 100: [2, 0, 1]}
    empty = table(spark, [], [])
    assert ann.nearest(empty, empty).columns == ["query_id", "rank", "vec_id", "score"] and ann.nearest(empty, empty).count() == 0
    assert ann.nearest(rows, empty).count() == 0


def test_hadamard_turns_are_rotations():
    x = np.random.default_rng(1).normal(0, 1, (7, 20))
    hasher = ann.CrossPolytope(20, 2, 1, 3)
    np.testing.assert_allclose(np.linalg.norm(hasher.turned(x, 1, 0), axis=1), np.linalg.norm(x, axis=1))
    assert (hasher.probe(x, 0, 3)[:, 0] == hasher.codes(x, 0)).all()


@pytest.mark.parametrize("size,step", [(1e4, 1e-3), (1e6, 1e-3), (1e8, 1.0), (0.0, 1.0)])
def test_no_candidate_is_lost_to_rounding(size, step):
    rng = np.random.default_rng(3)
    x = size * rng.normal(size=16) + step * rng.normal(size=(600, 16))
    x[300:] += size
    ids = np.arange(600)
    i, j, d = ann._best(ids[::3], x[::3], ids, x, 10)
    for n, q in enumerate(ids[::3]):
        assert [(int(ids[b]), e) for b, e in zip(j[i == n], d[i == n])] == brute(ids, x, q)
