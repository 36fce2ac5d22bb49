import importlib
import random

import pytest
from rows import EDGES

import corpus_pipeline
from newsloom.llm import decontaminate, line_dedup, packing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, lines string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("tor", "mel", "san", "vik", "dru", "pel", "hon") for b in ("a", "en", "ist", "ung", "or", "ly")]

    def prose(n):
        return "\n".join(" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(n))

    rows, labels = [], []
    for i in range(100, 260):
        good = i % 4 != 0
        rows.append((i, prose(4) if good else "BUY!! NOW!! $$$ ### " * 30))
        labels.append((i, int(good), 0))
    item = " ".join(rng.choices(words, k=25))
    whole = prose(6)
    rows += [
        (300, prose(2) + "\nread " + item + " well"), (301, whole), (302, whole), (303, prose(3) + "\n" + whole.split("\n")[2]), *EDGES,
    ]
    path = tmp_path_factory.mktemp("tables")
    table = [(i, t, "en", "s", len(t or ""), "r", None, "l") for i, t in rows]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(rows), whole


def test_stages_take_effect(spark, folder, tmp_path):
    path, texts, whole = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"
    ]
    ids = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, path)
        if name != "best_fit_packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "line_dedup":
            by = {r.doc_id: r for r in docs.collect()}
            assert whole.split("\n")[2] not in by[303].text and by[303].n_chars == len(by[303].text) < len(texts[303])
            assert by[301].text == whole and 302 not in by
    assert not [i for i in ids["quality_classifier"] if i and 100 <= i < 260 and i % 4 == 0]
    assert {i for i in range(100, 260) if i % 4} <= set(ids["quality_classifier"])
    assert ids["simhash_near_dedup"].count(5) <= 1 and 300 in ids["simhash_near_dedup"]
    assert 300 not in ids["benchmark_decontamination"] and 301 in ids["benchmark_decontamination"]
    assert sorted(i or 0 for i in set(ids["best_fit_packing"])) == sorted(i or 0 for i in set(ids["benchmark_decontamination"]))


def test_run_equals_the_operators_in_turn(spark, folder):
    path, *_ = folder
    docs, labels, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    docs = quality.keep_good(docs, quality.fit(docs, labels))
    docs = line_dedup.dedup_lines(docs.select("doc_id", "text"), counts=True)
    docs = docs.where("n_removed = 0 or text rlike '\\\\S'").select("doc_id", "text")
    docs = decontaminate.keep_clean(simhash.keep_one(docs), bench)
    want = packing.pieces(docs).collect()
    got = corpus_pipeline.run(spark, path)
    order = lambda r: tuple((x is None, x or 0) for x in r[:5])
    assert sorted([tuple(r)[:5] for r in got.collect()], key=order) == sorted(map(tuple, want), key=order)


def test_entry_lists_every_operator():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
