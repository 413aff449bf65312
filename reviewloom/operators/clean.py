"""Cleaning of raw reviews and of the raw catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.columns import (
    epoch_to_timestamp,
    flag,
    nan_to_null,
    short_date,
)
from reviewloom.sources.contracts import GAMES, REVIEW_FLAGS, REVIEWS


def helpful_vote(votes: Column) -> Column:
    """1 if a review got at least one vote, 0 if none, null if not known."""
    return flag(votes > 0)


def clean_reviews(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Prune to the columns in use, type them and add date, hours and helpful flag.

    ``keep`` names further columns to pass through, such as a row identifier.
    """
    playtime = ["author_playtime_forever", "author_playtime_at_review"]
    typed = df.select(*keep, *REVIEWS.names).withColumns(
        {
            "appid": F.col("appid").cast("bigint"),
            "votes_up": nan_to_null(F.col("votes_up")).cast("bigint"),
            "timestamp_created": F.col("timestamp_created").cast("bigint"),
            **{name: nan_to_null(F.col(name)).cast("bigint") for name in REVIEW_FLAGS},
            **{name: nan_to_null(F.col(name)) for name in playtime},
        }
    )
    return typed.withColumns(
        {
            "review_date": epoch_to_timestamp(F.col("timestamp_created")),
            "playtime_hours_at_review": F.col("author_playtime_at_review") / 60,
            "received_helpful_vote": helpful_vote(F.col("votes_up")),
        }
    )


def owner_bounds(df: DataFrame, column: str = "estimated_owners") -> DataFrame:
    """Split a ``lower - upper`` range and add its midpoint.

    ``0 - 0`` means that there is no estimate, so its midpoint is null. A range
    that does not have two whole numbers is an error.
    """
    ends = F.split(F.col(column), " - ")
    lower, upper = F.col("owner_lower"), F.col("owner_upper")
    return df.withColumns(
        {
            "owner_lower": ends[0].cast("bigint"),
            "owner_upper": F.element_at(ends, 2).cast("bigint"),
        }
    ).withColumn(
        "owner_midpoint",
        F.when((lower == 0) & (upper == 0), None).otherwise((lower + upper) / 2),
    )


def clean_games(df: DataFrame) -> DataFrame:
    """Prune to the columns in use, type key and release date, add owner bounds."""
    typed = df.select(*GAMES.names).withColumns(
        {
            "appID": F.col("appID").cast("bigint"),
            "release_date": short_date(F.col("release_date")),
        }
    )
    return owner_bounds(typed)


def owner_bucket_counts(games: DataFrame, column: str = "estimated_owners") -> DataFrame:
    """Games per ownership range, most frequent first."""
    return (
        games.groupBy(column)
        .agg(F.count(F.lit(1)).alias("game_count"))
        .orderBy(F.desc("game_count"), column)
    )


def missing_owner_estimates(games: DataFrame) -> DataFrame:
    """Number of games without an ownership estimate."""
    return games.agg(F.count_if(F.col("owner_midpoint").isNull()).alias("missing_owner_estimates"))
