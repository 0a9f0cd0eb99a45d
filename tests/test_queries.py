"""Registered queries against their SQL at the smallest scale (check.py runs them all)."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "recommend_signed_new_authors",
    "user_status",
    "recommend_mean",
    "search_catalog_by_grams",
    "pref_matches",
    "build_books",
    "embed_missing",
    "validate_ratings",
    "author_facet",
    "analogy_rank",
    "apply_dislikes_filter",
    "stream_ratings_snapshot",
    "edition_facets",
    "weighted_centroid",
    "choose_k",
    "cluster_corpus",
    "knn_approx",
    "near_duplicates_banded",
    "reduce_dims",
    "fit_projection",
    "kept_snapshot",
    "sql_similar_to_other_authors",
    "sql_recommend_from_preferences",
]

needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return connection


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@needs_data
def test_entry(spark):
    assert entry_points.entry(spark).count() == 75


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, entry_points.oracle_sql()[name])
    assert ok, note
