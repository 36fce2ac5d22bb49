"""Keyword ranking and graph ranking against straightforward Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import keywords as kw
from newsloom.operators import textrank as tr
from newsloom.plans import staging
from newsloom.sources.articles import segment_articles, to_terms

WORDS = [f"w{i:02d}" for i in range(14)]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(5)
    docs = []
    for i in range(12):
        title = " ".join(rnd.sample(WORDS, rnd.randint(0, 4)))
        lines = [" ".join(rnd.choices([*WORDS, "oov"], k=rnd.randint(1, 12))) for _ in range(rnd.randint(1, 4))]
        docs.append((i, title, "\n".join(lines)))
    docs.append((99, "w01", ""))
    vecs = {}
    for w in WORDS:
        v = [rnd.gauss(0, 1) for _ in range(4)]
        n = math.sqrt(sum(x * x for x in v))
        vecs[w] = [x / n for x in v]
    idf = {w: 0.5 + i * 0.25 for i, w in enumerate(WORDS[1:])}
    articles = spark.createDataFrame(docs, "id long, title string, content string")
    vec_df = staging.stage(spark.createDataFrame(list(vecs.items()), "word string, vec array<double>"))
    stat_df = staging.stage(
        spark.createDataFrame([(w, 3, 2, x) for w, x in idf.items()], "word string, tf long, df long, idf double")
    )
    terms = to_terms(segment_articles(articles, dedup=False))
    return docs, vecs, idf, terms, vec_df, stat_df


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def semantic(doc, vecs, idf, k=3):
    title = [w for w in doc[1].split() if w in vecs]
    words = title + [w for w in doc[2].split() if w in vecs]
    distinct = list(dict.fromkeys(words))
    sim = {w: round(sum(dot(vecs[w], vecs[x]) for x in distinct if x != w), 9) for w in distinct}
    tfidf = {w: idf.get(w, 0.0) * words.count(w) for w in distinct}

    def scale(values):
        low, high = min(values.values()), max(values.values())
        return {w: (x - low) / ((high - low) or 1) for w, x in values.items()}

    if not distinct:
        return []
    s, t = scale(sim), scale(tfidf)
    score = {w: round(s[w] + t[w] + (w in title), 6) for w in distinct}
    return sorted(((w, x) for w, x in score.items()), key=lambda p: (-p[1], p[0]))[:k]


def by_id(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append((r["word"], r["score"]))
    return out


def test_semantic_keywords(corpus):
    docs, vecs, idf, terms, vec_df, stat_df = corpus
    got = by_id(kw.semantic_keywords(terms, vec_df, stat_df).collect())
    for doc in docs:
        want = semantic(doc, vecs, idf)
        assert [w for w, _ in got.get(doc[0], [])] == [w for w, _ in want]
        assert [x for _, x in got.get(doc[0], [])] == pytest.approx([x for _, x in want], abs=2e-6)


def test_semantic_keywords_without_broadcast(corpus, spark, monkeypatch):
    docs, vecs, idf, terms, vec_df, stat_df = corpus
    want = kw.semantic_keywords(terms, vec_df, stat_df).collect()
    monkeypatch.setattr(staging.broadcast_if_small, "__defaults__", (0,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kw.semantic_keywords(terms, vec_df, stat_df)
        assert sorted(plan.collect()) == sorted(want)
        rank = tr.textrank_keywords(terms, vec_df, stat_df, weights={"s": 1, "i": 1}).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert sorted(rank) == sorted(tr.textrank_keywords(terms, vec_df, stat_df, weights={"s": 1, "i": 1}).collect())


def test_running_fold_keeps_the_last_non_maximum(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 5.0],)], "v array<double>")
    fold = df.select(kw.running_fold(F.col("v")).alias("f")).first()["f"]
    assert (fold["high"], fold["low"]) == (5.0, 2.0)


def test_minmax_zero_range(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0)], "id int, x double")
    assert [r["x"] for r in kw.minmax_scale(df, "id", ["x"]).collect()] == [0.0, 0.0]


def graph_rank(doc, vecs, idf, weights, window=5, content=True, sigmoid=False, rounds=20, tol=1e-4):
    title = list(dict.fromkeys(w for w in doc[1].split() if w in vecs))
    lines = [[w for w in line.split() if w in vecs] for line in doc[2].split("\n")]
    links = {w: set(title) - {w} for w in title}
    for line in lines:
        for w in line:
            links.setdefault(w, set())
        if content:
            for i, a in enumerate(line):
                for b in line[i + 1 : i + window]:
                    if a != b:
                        links[a].add(b)
                        links[b].add(a)
    pos = {w: 10.0 if w in title else 1.0 for w in links}
    idfs = {w: idf.get(w, 1.0) for w in links}
    total = sum(weights.values())

    def weight(a, b):
        sim = dot(vecs[a], vecs[b])
        if sigmoid:
            sim = 1 / (1 + math.exp(-max(-6, min(6, sim))))
        parts = {
            "u": 1 / len(links[a]), "s": sim / len(links[a]),
            "p": pos[b] / sum(pos[x] for x in links[a]), "i": idfs[b] / sum(idfs[x] for x in links[a]),
        }
        return sum(w / total * parts[k] for k, w in weights.items())

    score, it = {w: 1.0 for w in links}, 0
    while links and it < rounds:
        new = {b: 0.15 + 0.85 * sum(score[a] * weight(a, b) for a in links[b]) for b in links}
        change = max(abs(new[w] - score[w]) for w in links)
        score, it = new, it + 1
        if change <= tol:
            break
    best = sorted(((w, round(x, 6)) for w, x in score.items()), key=lambda p: (-p[1], p[0]))
    return best[:4], it


@pytest.mark.parametrize(
    ("weights", "options"),
    [
        ({"u": 1}, {}), ({"p": 3, "i": 2}, {}), ({"s": 4, "p": 6}, {}),
        ({"u": 2, "p": 4, "i": 4}, {"content": False}), ({"s": 1}, {"sigmoid": True}),
    ],
)
def test_textrank(corpus, weights, options):
    docs, vecs, idf, terms, vec_df, stat_df = corpus
    rows = tr.textrank_keywords(
        terms, vec_df, stat_df, weights=weights,
        content_edges=options.get("content", True), use_sigmoid=options.get("sigmoid", False),
    ).collect()
    got, its = by_id(rows), {r["id"]: r["it"] for r in rows}
    for doc in docs:
        want, it = graph_rank(doc, vecs, idf, weights, **options)
        if not want:
            assert doc[0] not in got
            continue
        assert [w for w, _ in got[doc[0]]] == [w for w, _ in want]
        assert [x for _, x in got[doc[0]]] == pytest.approx([x for _, x in want], abs=2e-6)
        assert its[doc[0]] == it


def test_title_clique_scores_one(corpus, spark):
    _, _, _, _, vec_df, stat_df = corpus
    articles = spark.createDataFrame([(1, "w01 w02 w03", "")], "id long, title string, content string")
    terms = to_terms(segment_articles(articles))
    rows = tr.textrank_keywords(terms, vec_df, stat_df, weights={"u": 1}).collect()
    assert [r["score"] for r in rows] == [1.0, 1.0, 1.0]


def test_weight_grid_and_specs():
    grid = tr.weight_grid()
    assert len(grid) == 36 and all(sum(g.values()) == 10 for g in grid)
    assert tr.parse_weights("u2_p8") == tr.parse_weights("u-2_p-8") == {"u": 2, "p": 8}
