"""Registered queries against their SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

from check import compare, connect

SF = "/root/testdata/sf0.001"
SOME = [
    "tfidf_top_terms", "semantic_keywords", "textrank_blend", "word_neighbours", "cooccurrence_expansion",
    "leader_cluster_best", "recluster_until_stable", "partition_merge", "threshold_ladder_resumed",
    "write_catalog_partitions", "segment_articles", "textrank_weight_sweep", "edge_weights", "classifier_weights", "nearest_centroid", "keyword_features", "body_text_json_or_markup",
]
NO_SQL = set()


def test_every_query_has_sql_or_is_known_not_to():
    # The training-data queries, which may be absent, have tests of their own.
    assert set(entry.registry.QUERIES) - set(entry.registry.ORACLES) == NO_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connect(SF), name, SF)
    assert ok, note
