"""Large and small groups give the same summary; totals agree between summaries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import clean, features, summaries
from reviewloom.operators.network import cooccurrence_edges, explode_list, list_edges
from reviewloom.plans import standins


@pytest.fixture(scope="module")
def reviews(spark, sf_dir):
    lines = clean.clean_reviews(standins.lineitem_reviews(spark, sf_dir, appid="l_orderkey"))
    return features.text_features(lines)


def _sorted(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_rollup_matches_plain_aggregation(reviews):
    """A third of the rows in one group, a null group and null flags."""
    skewed = reviews.withColumns(
        {
            "appid": F.when(F.col("voted_up") == 0, -1)
            .when(F.col("votes_up") == 6, None)
            .otherwise(F.col("appid")),
            "voted_up": F.when(F.col("votes_up") != 2, F.col("voted_up")),
            "playtime_hours_at_review": F.when(
                F.col("votes_up") != 1, F.col("playtime_hours_at_review")
            ),
        }
    )
    plain = skewed.groupBy("appid").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg("voted_up").alias("approval_rate"),
        F.avg("received_helpful_vote").alias("helpful_review_rate"),
        F.avg("written_during_early_access").alias("early_access_share"),
        F.median("playtime_hours_at_review").alias("median_playtime_hours"),
        F.median("review_length").alias("median_review_length"),
    )
    ours = summaries.game_review_summary(skewed)
    assert _sorted(ours) == _sorted(plain)


def test_totals_agree_between_summaries(spark, sf_dir, reviews):
    games = clean.clean_games(standins.order_games(spark, sf_dir))
    joined = features.add_lifecycle(reviews, games.select("appID", "release_date")).cache()
    quartiles = summaries.playtime_summary(reviews).collect()
    stages = summaries.lifecycle_summary(joined).collect()
    cross = summaries.flag_crosstab(
        joined, "before_release", "written_during_early_access"
    ).collect()
    total = reviews.count()
    for rows in (quartiles, stages, cross):
        assert sum(r.review_count for r in rows) == total
    for rate in ("approval_rate", "helpful_review_rate"):
        assert sum(r[rate] * r.review_count for r in quartiles) == pytest.approx(
            sum(r[rate] * r.review_count for r in stages)
        )
    early = sum(r.review_count for r in cross if r.written_during_early_access == 1)
    assert sum(r.early_access_share * r.review_count for r in stages) == pytest.approx(early)
    by_stage = {r.lifecycle_group: r.review_count for r in stages}
    assert by_stage["Before release"] == sum(
        r.review_count for r in cross if r.before_release == 1
    )
    assert by_stage["Missing release date"] == sum(
        r.review_count for r in cross if r.before_release is None
    )
    assert cross[0].before_release is None
    joined.unpersist()


def test_edges_from_lists_and_from_long_form_agree(spark):
    rows = [(1, ["A", "B", "C"]), (2, ["B", "A"]), (3, ["A", "A", "B"]), (4, None), (5, [None, "A"])]
    games = spark.createDataFrame(rows, "appID bigint, genres array<string>")
    long = explode_list(games, keys=["appID"])
    expected = [("A", "B", 4), ("A", "C", 1), ("B", "C", 1)]
    assert [tuple(r) for r in list_edges(games).collect()] == expected
    assert [tuple(r) for r in cooccurrence_edges(long).collect()] == expected
    for block in (1, 2, 1000):
        assert [tuple(r) for r in list_edges(games, block=block).collect()] == expected
        assert [tuple(r) for r in cooccurrence_edges(long, block=block).collect()] == expected
        deduped = cooccurrence_edges(long, dedupe=True, block=block).collect()
        assert [tuple(r) for r in deduped] == [("A", "B", 3), ("A", "C", 1), ("B", "C", 1)]


def test_pairs_of_a_wide_entity_are_spread(spark):
    """One entity of 5,000 items: no row makes more pairs than two blocks have."""
    long = spark.range(5000).select(F.lit(1).alias("appID"), F.format_string("%04d", "id").alias("genre"))
    edges = cooccurrence_edges(long)
    assert edges.agg(F.count("*"), F.sum("shared_games")).first() == (12497500, 12497500)
    listed = long.groupBy("appID").agg(F.collect_list("genre").alias("genres"))
    assert list_edges(listed).count() == 12497500
