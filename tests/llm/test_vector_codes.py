import hashlib
import math
import random

import numpy as np
import pytest

from newsloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, vec string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, "c", "e", "v") for i, v, x in rows], SCHEMA)


def plain(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks by loops over Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width: (p + 1) * width]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in order] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, rows_ in held.items():
                books[p][k] = [sum(x) // len(rows_) for x in zip(*rows_)]
    out, sums = [], {}
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(i, code, error, sums[label], digest) for i, code, error, label in out], key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def vectors(n, dim, seed, size=1.0):
    rng = random.Random(seed)
    f = lambda x: float(np.float32(x))
    return [(i, [f(rng.gauss(0, size)) for _ in range(dim)], rng.choice([None, 1, 2, 2, 2])) for i in range(n)]


@pytest.mark.parametrize(("n", "entries", "size"), [(300, 16, 0.2), (90, 256, 0.2), (200, 16, 300.0)])
def test_equals_plain_loops(spark, n, entries, size):
    rows = vectors(n, 8, n, size)
    rows += [(n + 1, None, 1), (n + 2, [], 1), (n + 3, [1.0] * 7 + [None], 1), (n + 4, [1.0] * 7 + [math.nan], 2), (-5, [math.inf] + [0.0] * 7, 2)]
    rows += [rows[3], rows[3], (None, [0.25] * 8, None), (7, [-0.5] * 8, 9), (n + 5, [0.0] * 8, 3)]
    assert got(V.compress_vectors(table(spark, rows).repartition(5), entries=entries)) == plain(rows, entries=entries)


def test_ties_go_to_the_lower_entry():
    book = np.array([[0, 0], [2, 0], [2, 0], [-2, 0]])
    at, distance = V.nearest(np.array([[1, 0], [-1, 0], [2, 0], [0, 5]]), book)
    assert at.tolist() == [0, 0, 1, 0] and distance.tolist() == [1, 1, 0, 25]


@pytest.mark.parametrize("bits", [8, 20, 26, 27, 29])
def test_dot_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    a, b = (rng.integers(-(1 << bits), 1 << bits, (40, 9)) for _ in range(2))
    a[0], b[0] = (1 << bits) - 1, -(1 << bits)
    want = [[sum(x * y for x, y in zip(r, s)) for s in b.tolist()] for r in a.tolist()]
    assert V.exact_dots(a, b).tolist() == want
    # Short limbs give the same, and each product stays exact.
    assert V.exact_dots(a, b, exact_bits=16).tolist() == want
    assert len(V.limbs(a, 24)) == (1 if bits < 24 else 2)


def test_empty_and_unfit_tables(spark):
    assert V.compress_vectors(table(spark, [])).collect() == []
    assert V.compress_vectors(table(spark, [(1, None, 1), (2, [math.nan] * 4, 1)])).collect() == []
    with pytest.raises(ValueError):
        V.compress_vectors(table(spark, [(1, [1.0] * 6, 1)]))
