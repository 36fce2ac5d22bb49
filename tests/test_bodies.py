"""A long first line is a part of the body in the queries that read bodies."""

import pytest

from newsloom.registry import QUERIES, load
from newsloom.registry import corpus as c

load()
LONG = " ".join(f"zzabcde{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
ROWS = [
    (1, LONG, "en", "s0"),
    (2, f"{LONG}\nsecond paragraph stands here", "en", "s0"),
    (3, "a headline\nbody text stands here", "en", "s1"),
    (4, None, "en", "s1"),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bodies")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_bodies_keep_long_first_lines(spark, sf):
    rows = {r["id"]: r for r in c.segmented(spark, sf, c.HEADLINE).collect()}
    assert rows[1]["title_words"] == [] and rows[1]["sentences"] == [LONG.split(" ")]
    assert rows[2]["sentences"] == [LONG.split(" "), ["second", "paragraph", "stands", "here"]]
    assert rows[3]["title_words"] == ["a", "headline"] and rows[3]["sentences"] == [["body", "text", "stands", "here"]]
    assert rows[4]["title_words"] == [] and rows[4]["sentences"] == []


def test_pairs_of_long_first_lines_count(spark, sf):
    a, b = sorted(LONG.split(" ")[:2])
    pairs = {(r["a"], r["b"]): r["n"] for r in QUERIES["cooccurrence_pairs"](spark, sf).collect()}
    assert pairs[a, b] == 2


def test_sentences_of_long_first_lines(spark, sf):
    rows = {(r["id"], r["sentence"]) for r in QUERIES["segment_articles"](spark, sf).collect()}
    assert {(1, 1), (2, 1), (2, 2), (3, 0), (3, 1)} <= rows and (1, 0) not in rows
