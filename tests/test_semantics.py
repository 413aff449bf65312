"""Null, tie, boundary and parsing rules on small hand-made frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import columns
from reviewloom.operators import clean, features, network, quality
from reviewloom.sources.contracts import REVIEWS


def _apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]


def _review(**changed):
    row = dict.fromkeys(REVIEWS.names)
    row.update(appid=1.0, timestamp_created=0.0, voted_up=1.0)
    row.update(changed)
    return tuple(row[name] for name in REVIEWS.names)


def test_word_count_uses_unicode_blanks(spark):
    texts = ["", "   ", "a b", " a\n\tb ", "a b　c", "\U0001f600 ok", None]
    assert _apply(spark, columns.word_count, texts) == [1, 1, 2, 2, 3, 2, None]


def test_length_counts_code_points(spark):
    assert _apply(spark, columns.text_length, ["", "aé", "\U0001f600 ok", None]) == [
        0,
        2,
        4,
        None,
    ]


def test_short_date(spark):
    texts = [
        "Oct 1, 2008",
        "Oct 21, 2008",
        "oct 21, 2008",
        "Oct 2008",
        "Feb 31, 2020",
        "October 21, 2008",
        "2008-10-21",
        "",
        None,
    ]
    day = dt.date(2008, 10, 21)
    assert _apply(spark, columns.short_date, texts) == [dt.date(2008, 10, 1), day, day] + [None] * 6


def test_epoch_and_month_do_not_depend_on_the_session_zone(spark):
    seconds = [0.0, 0.9, 1709251199.0, 1709251200.0]
    moments = [
        dt.datetime(1970, 1, 1),
        dt.datetime(1970, 1, 1),
        dt.datetime(2024, 2, 29, 23, 59, 59),
        dt.datetime(2024, 3, 1),
    ]
    months = [m.replace(day=1, hour=0, minute=0, second=0) for m in moments]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            stamp = columns.epoch_to_timestamp
            assert _apply(spark, stamp, seconds, "double") == moments
            month = lambda c: columns.month_start(columns.epoch_to_timestamp(c))
            assert _apply(spark, month, seconds, "double") == months
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_lifecycle_boundaries(spark):
    lags = [None, -1, 0, 30, 31, 180, 181, 365, 366, 1095, 1096]
    df = spark.createDataFrame([(lag,) for lag in lags], "days_since_release bigint")
    rows = features.add_lifecycle_stage(df).collect()
    found = {r.days_since_release: (r.before_release, r.lifecycle_group) for r in rows}
    assert found == {
        None: (None, "Missing release date"),
        -1: (1, "Before release"),
        0: (0, "First 30 days"),
        30: (0, "First 30 days"),
        31: (0, "1-6 months"),
        180: (0, "1-6 months"),
        181: (0, "6-12 months"),
        365: (0, "6-12 months"),
        366: (0, "1-3 years"),
        1095: (0, "1-3 years"),
        1096: (0, "3+ years"),
    }


def test_unknown_game_and_unparseable_date_are_both_missing(spark):
    reviews = spark.createDataFrame(
        [(1, dt.datetime(2020, 1, 1)), (2, dt.datetime(2020, 1, 1)), (3, dt.datetime(2020, 1, 1))],
        "appid bigint, review_date timestamp_ntz",
    )
    games = spark.createDataFrame([(1, "Dec 31, 2019"), (2, "2019")], "appID bigint, d string")
    games = games.select("appID", columns.short_date(F.col("d")).alias("release_date"))
    rows = features.add_lifecycle(reviews, games).orderBy("appid").collect()
    assert [r.days_since_release for r in rows] == [1, None, None]
    assert [r.before_release for r in rows] == [0, None, None]


def test_helpful_flag(spark):
    assert _apply(spark, clean.helpful_vote, [None, 0, 1, 2], "bigint") == [None, 0, 1, 1]


def test_extreme_text_of_unknown_text_is_unknown(spark):
    df = spark.createDataFrame([(None,), ("x" * 8000,), ("x" * 8001,)], "review string")
    flags = [r.extreme_text for r in features.text_features(df).collect()]
    assert flags == [None, 0, 1]


def test_clean_reviews_types_and_nan(spark):
    nan = float("nan")
    rows = [
        _review(author_playtime_at_review=90.0, votes_up=2.0),
        _review(author_playtime_at_review=nan, voted_up=nan),
    ]
    first, second = clean.clean_reviews(spark.createDataFrame(rows, REVIEWS)).collect()
    assert (first.appid, first.playtime_hours_at_review, first.received_helpful_vote) == (1, 1.5, 1)
    assert first.review_date == dt.datetime(1970, 1, 1)
    assert (second.author_playtime_at_review, second.voted_up) == (None, None)
    assert second.received_helpful_vote is None


def test_bad_key_is_an_error(spark):
    bad = spark.createDataFrame([_review(appid=float("nan"))], REVIEWS)
    with pytest.raises(Exception, match="CAST"):
        clean.clean_reviews(bad).collect()


def test_owner_bounds(spark):
    df = spark.createDataFrame([("0 - 0",), ("0 - 20000",), (None,)], "estimated_owners string")
    rows = [tuple(r)[1:] for r in clean.owner_bounds(df).collect()]
    assert rows == [(0, 0, None), (0, 20000, 10000.0), (None, None, None)]
    malformed = spark.createDataFrame([("5",)], "estimated_owners string")
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        clean.owner_bounds(malformed).collect()


def test_explode_drops_null_and_empty(spark):
    rows = [(1, None), (2, []), (3, [None, "A"]), (4, ["A", "B"])]
    games = spark.createDataFrame(rows, "appID bigint, genres array<string>")
    long = network.explode_list(games, keys=["appID"])
    assert [tuple(r) for r in long.orderBy("appID", "genre").collect()] == [
        (3, "A"),
        (4, "A"),
        (4, "B"),
    ]
    counts = quality.list_population(games, ["genres"]).first()
    assert (counts.total_games, counts.games_with_genres) == (4, 2)


def test_network_tables(spark):
    long = spark.createDataFrame(
        [(i, g) for i in range(1200) for g in ("Action", "Indie")] + [(9999, "Rare")],
        "appID bigint, genre string",
    )
    edges = network.strong_edges(network.cooccurrence_edges(long), 1000)
    assert [r.title for r in network.network_edges(edges).collect()] == ["1,200 shared games"]
    nodes = network.network_nodes(long, edges).orderBy("id").collect()
    assert [r.title for r in nodes] == ["Action: 1,200 games", "Indie: 1,200 games"]
    assert network.node_count(edges).first().genres_in_network == 2


def test_longest_texts(spark):
    df = spark.createDataFrame([(1, "a" * 300), (2, None), (3, "b" * 300), (4, "c")], "id int, review string")
    rows = features.longest_texts(df, "id", k=2).collect()
    assert [(r.id, r.review_length, r.review_preview) for r in rows] == [
        (1, 300, "a" * 200),
        (3, 300, "b" * 200),
    ]


def test_join_audit_counts_fact_rows_once(spark):
    fact = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k bigint")
    dimension = spark.createDataFrame([(1, "a"), (1, "b")], "k bigint, name string")
    row = quality.join_audit(fact, dimension, "k").first()
    assert (row.total_rows, row.unmatched_rows, row.coverage) == (4, 2, 0.5)
    assert quality.unmatched_rows(fact, dimension, "k").count() == 2


def test_profiles_count_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "1"), (float("nan"), "x"), (None, "1.5")], "v double, k string")
    assert [r.null_count for r in quality.null_profile(df).collect()] == [2, 0]
    check = quality.binary_domain_check(df, ["v"]).first()
    assert (check.zeros, check.ones, check.nulls, check.other_values) == (0, 1, 2, 0)
    keys = quality.key_profile(df, "k").first()
    assert (keys.unique_keys, keys.min_key, keys.max_key, keys.parse_failures) == (2, 1.0, 1.5, 1)


def test_flag_of_an_unknown_predicate(spark):
    rows = spark.sql("SELECT * FROM VALUES (true), (false), (null) AS t(x)")
    found = rows.select(columns.flag(F.col("x")), columns.flag(F.col("x"), unknown=0)).collect()
    assert [tuple(r) for r in found] == [(1, 1), (0, 0), (None, 0)]


def test_join_refuses_a_repeated_game(spark):
    reviews = spark.createDataFrame([(1, "a"), (3, "b")], "appid bigint, game string")
    games = spark.createDataFrame(
        [(1, "x"), (1, "x"), (2, "y"), (None, "z"), (None, "z")], "appID bigint, name string"
    )
    for use in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("game").collect()):
        with pytest.raises(Exception, match="appid is not unique: 1"):
            use(features.join_games(reviews, games))
    unique = features.join_games(reviews, games.distinct()).orderBy("appid").collect()
    assert [tuple(r) for r in unique] == [(1, "a", "x"), (3, "b", None)]
