import math
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import cooccurrence as co
from newsloom.operators import neighbours as nb
from newsloom.operators import similarity as sim


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(3)
    vecs = {f"w{i:03d}": unit([rnd.gauss(0, 1) for _ in range(5)]) for i in range(60)}
    copy = vecs["w000"]
    vecs.update({f"c{i:02d}": copy for i in range(30)})  # a third of the rows are one vector
    return vecs


def best(vecs, k, keep):
    out = set()
    for w, v in vecs.items():
        scored = [(x, round(dot(v, u), 6)) for x, u in vecs.items() if x != w]
        scored = sorted((p for p in scored if keep(p[1])), key=lambda p: (-p[1], p[0]))[:k]
        out |= {(w, i + 1, x, s) for i, (x, s) in enumerate(scored)}
    return out


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_word_neighbours(spark, vectors, block_rows):
    df = spark.createDataFrame(list(vectors.items()), "word string, vec array<double>")
    got = nb.word_neighbours(df, k=6, threshold=0.2, block_rows=block_rows).collect()
    assert {(r["word"], r["rank"], r["neighbour"], r["score"]) for r in got} == best(vectors, 6, lambda s: s > 0.2)
    pairs = nb.pair_similarity(df, k=3, block_rows=block_rows).collect()
    assert {(r["word"], r["rank"], r["neighbour"], r["score"]) for r in pairs} == best(vectors, 3, lambda s: True)


def test_low_similarity_and_matrix(spark, vectors):
    df = spark.createDataFrame(list(vectors.items()), "id string, vec array<double>")
    want = {}
    for w, v in vectors.items():
        sims = sorted((round(dot(v, u), 6), x) for x, u in vectors.items() if x != w)
        want[w] = (sum(s <= 0.3 for s, _ in sims), *sims[0])
    got = nb.low_similarity(df, flag_below=0.3, block_rows=9).collect()
    assert {r["id"]: (r["n_low"], r["lowest"], r["lowest_id"]) for r in got} == want
    lowest = sim.lowest_similarities(df, k=2, flag_below=0.3).collect()
    for w, v in vectors.items():
        sims = sorted((round(dot(v, u), 6), x) for x, u in vectors.items() if x != w)
        best_two = [(s, x) for s, x in sims if s <= 0.3][:2]
        assert [(r["sim"], r["other"]) for r in sorted(lowest, key=lambda r: r["rank"]) if r["id"] == w] == best_two


def test_similar_documents(spark):
    df = spark.createDataFrame([(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(20)], "id long, vec array<double>")
    found = sim.similar_documents(df, 5, threshold=math.cos(0.35)).orderBy("id")
    assert [r["id"] for r in found.collect()] == [2, 3, 4, 5, 6, 7, 8]
    assert [r["id"] for r in sim.similar_documents(df, 5, threshold=0.0, limit=3).collect()] == [0, 1, 2]


def test_pairs_and_shared_words(spark):
    docs = spark.createDataFrame(
        [(1, [1.0, 0.0], ["a", "b"]), (2, [1.0, 1.0], ["b"])], "id long, vec array<double>, ws array<string>"
    )
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "id_a long, id_b long")
    rows = sim.doc_pair_similarity(docs, pairs).collect()
    assert len(rows) == 1 and rows[0]["sim"] == pytest.approx(math.sqrt(0.5))
    items = docs.select("id", F.transform("ws", lambda w: F.struct(w.alias("word"), F.lit(1.0).alias("weight"))).alias("words"))
    ranked = {r["id"]: (r["shared"], r["joined"]) for r in sim.shared_words_rank(items, ["b", "c"]).collect()}
    assert ranked == {1: (1, 3), 2: (1, 2)}


def test_cooccurrence_windows(spark):
    df = spark.createDataFrame([(list("abcdef"),), (["x"],), ([],), (["a", "a", "b"],)], "words array<string>")
    pairs = co.cooccurrence_pairs(df)
    # a..f: distances 1..4 give 14; "a a b" adds two for (a, b); equal words do not pair
    assert pairs.agg({"n": "sum"}).first()[0] == 16
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()}[("a", "b")] == 3


def test_expansion_and_window_tf(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "b"],), (["a", "c"],)], "words array<string>")
    pairs = co.cooccurrence_pairs(df)
    vocabulary = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "word string")
    tf = {r["word"]: r["tf"] for r in co.window_tf(pairs, vocabulary).collect()}
    assert tf == {"a": 3, "b": 2, "c": 1, "z": 0}
    rows = co.expansion_lists(co.cooccurrence_expansion(pairs, k=20), vocabulary).collect()
    lists = {r["word"]: [(p["word"], p["score"]) for p in r["partners"]] for r in rows}
    assert lists["a"] == [("b", 2 / 6), ("c", 1 / 3)] or lists["a"] == [("b", 2 / 6.0), ("c", 1 / 3.0)]
    assert lists["z"] == []
