"""Whole jobs on stand-in tables written as raw Parquet, against the operators."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from reviewloom.plans import jobs, standins
from reviewloom.sources.contracts import ContractError


@pytest.fixture(scope="module")
def raw(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    reviews = standins.lineitem_reviews(spark, sf_dir, appid="l_orderkey")
    reviews.repartition(3).write.parquet(f"{folder}/reviews")
    standins.order_games(spark, sf_dir).write.parquet(f"{folder}/games")
    return f"{folder}/reviews", f"{folder}/games"


def _rows(df):
    df = df.select(*sorted(df.columns))
    rounded = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()]
    return sorted(rounded, key=repr)


def _same(spark, sf_dir, path, query):
    assert _rows(spark.read.parquet(path)) == _rows(contract.queries()[query](spark, sf_dir))


def test_playtime_and_lifecycle_jobs(spark, sf_dir, raw, tmp_path):
    reviews, games = raw
    out = str(tmp_path)
    jobs.playtime_job(spark, reviews, out)
    jobs.lifecycle_job(spark, reviews, games, out)
    _same(spark, sf_dir, f"{out}/q1_playtime_summary", "playtime_quartile_summary")
    _same(spark, sf_dir, f"{out}/q2_lifecycle_summary", "lifecycle_summary")
    _same(spark, sf_dir, f"{out}/q2_early_access_check", "early_access_crosstab")
    labels = [r.playtime_group for r in spark.read.parquet(f"{out}/q1_playtime_summary").collect()]
    assert labels == ["Low", "Moderate", "High", "Very High"]
    for name, header in {
        "q1_playtime_summary": "playtime_group,review_count,approval_rate,median_playtime_hours,"
        "helpful_review_rate",
        "q2_lifecycle_summary": "lifecycle_group,review_count,approval_rate,"
        "median_playtime_hours,helpful_review_rate,early_access_share",
        "q2_early_access_check": "before_release,written_during_early_access,review_count",
    }.items():
        assert ",".join(spark.read.csv(f"{out}/{name}_csv", header=True).columns) == header
    csv = spark.read.csv(f"{out}/q2_early_access_check_csv", header=True).collect()
    assert len(csv) == 6 and csv[0].before_release is None


def test_catalogue_and_network_jobs(spark, raw, tmp_path):
    _, games = raw
    out = str(tmp_path)
    jobs.catalogue_job(spark, games, out)
    cleaned = spark.read.parquet(f"{out}/games_clean")
    assert cleaned.count() == spark.read.parquet(games).count()
    assert {"owner_lower", "owner_upper", "owner_midpoint"} <= set(cleaned.columns)
    jobs.network_job(spark, games, out, threshold=50)
    edges = spark.read.parquet(f"{out}/network_edges").collect()
    nodes = {r.id: r.value for r in spark.read.parquet(f"{out}/network_nodes").collect()}
    assert edges and all(r["from"] < r.to and r.value >= 50 for r in edges)
    assert nodes.keys() == {r["from"] for r in edges} | {r.to for r in edges}


def test_rollup_job(spark, raw, tmp_path):
    reviews, _ = raw
    jobs.rollup_job(spark, reviews, str(tmp_path))
    games = spark.read.parquet(f"{tmp_path}/game_review_summary")
    months = spark.read.parquet(f"{tmp_path}/game_monthly_reviews")
    total = spark.read.parquet(reviews).count()
    for table in (games, months):
        assert table.agg({"review_count": "sum"}).first()[0] == total


def test_job_refuses_files_that_break_the_contract(spark, raw, tmp_path):
    reviews, _ = raw
    spark.read.parquet(reviews).drop("votes_up").write.parquet(f"{tmp_path}/bad")
    with pytest.raises(ContractError, match="votes_up"):
        jobs.playtime_job(spark, f"{tmp_path}/bad", str(tmp_path))
