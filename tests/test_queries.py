"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import pytest
from compare import kinds, spark_rows, sql_rows, tables

import __spark_entry__ as contract
from reviewloom.plans.catalog import QUERIES as CATALOG

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()
SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


# The smallest tables have no edge that is heavy enough.
LARGER = {"strong_edges", "network_node_count", "network_nodes", "network_edges"}
LARGER_DIR = "/root/testdata/sf0.01"


def test_every_query_has_sql():
    # Optional queries without one are held to brute force in their own tests.
    assert set(CATALOG) <= set(ORACLES) <= set(QUERIES)


def test_entry_gives_the_four_buckets_in_order(spark):
    rows = contract.entry(spark).collect()
    assert [r.playtime_group for r in rows] == ["Low", "Moderate", "High", "Very High"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    sf_dir = LARGER_DIR if name in LARGER else sf_dir
    con = tables(sf_dir)
    df = QUERIES[name](spark, sf_dir)
    described = con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in df.schema} == {
        row[0]: row[1] for row in described
    }
    ours, theirs = spark_rows(df), sql_rows(con, ORACLES[name])
    assert ours == theirs
    assert kinds(ours) == kinds(theirs)
    assert ours[1], "a query without rows checks nothing"


# Results whose order is part of them, and the SQL of that order.
ORDERED = {
    "owner_bucket_counts": "game_count DESC, estimated_owners",
    "lifecycle_counts": "review_count DESC, lifecycle_group",
    "pre_release_games": "pre_release_reviews DESC, appid, game_name, release_date",
    "genre_counts": "game_count DESC, genre",
    "top_genres": "game_count DESC, genre",
    "value_counts": "count DESC, voted_up",
    "language_mix": "count DESC, lang",
    "extreme_text_counts": "count DESC, extreme_text",
    "early_access_crosstab": "before_release NULLS FIRST, written_during_early_access NULLS FIRST",
    "longest_texts": "review_length DESC, doc_id",
    "genre_edges": "shared_games DESC, genre, genre_2",
    "cooccurrence_pairs": "shared_games DESC, genre, genre_2",
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_rows_come_in_order(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    sql = f"SELECT {columns} FROM ({ORACLES[name]}) ORDER BY {ORDERED[name]}"
    expected = tables(sf_dir).execute(sql).fetchall()
    assert [tuple(r) for r in df.collect()] == expected
    assert len(expected) > 1


def test_oracles_can_fail(sf_dir):
    """The counted cases occur, and not in every row."""
    con = tables(sf_dir)
    total, tags, genres, _ = con.execute(ORACLES["list_population"]).fetchone()
    assert tags == 0 < genres < total
    for name in ("review_key_profile", "game_key_profile"):
        unique, _, _, failures = con.execute(ORACLES[name]).fetchone()
        assert failures > 0 < unique
