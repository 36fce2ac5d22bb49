import random

import pytest
import xxhash
from rows import EDGES, documents

from newsloom.llm import simhash
from newsloom.llm.common import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def some_fingerprints(seed=3):
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(6):  # chains
        x = rng.getrandbits(64)
        for _ in range(12):
            out.add(x)
            for bit in rng.sample(range(64), rng.choice([1, 3, 4, 5])):
                x ^= 1 << bit
    ball = rng.getrandbits(64)
    out |= {ball ^ (1 << a) ^ (1 << b) for a in range(0, 40, 3) for b in range(1, 40, 3)}
    return out


def test_fingerprints_and_edge_rows(spark):
    rows = EDGES + [(10, "the quick brown fox jumps over the lazy dog"), (11, "The QUICK brown fox jumps\nover the lazy dog"), (12, "Ä b c d e É")]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted(
        (i is None, i or 0, f"{plain_fingerprint(t):016x}") for i, t in rows
    )
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[11] == by_id[10] == 10 and by_id[None] is None
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("subtree", [1 << 16, 40])
def test_links_are_those_of_all_pairs(spark, monkeypatch, subtree):
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    monkeypatch.setattr(simhash, "MEAN", 64)
    fps = some_fingerprints()
    want = plain_components(fps)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    got = {r.node: r.component for r in components(simhash.links(frame)).collect()}
    groups = {}
    for f, root in want.items():
        groups.setdefault(root, set()).add(signed[f])
    mine = {}
    for node, root in got.items():
        mine.setdefault(root, set()).add(node)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(9, text), (4, text), (4, text), (6, text + " more"), (1, None), (2, None), (8, "something else entirely here")]
    docs = documents(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 8]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0
