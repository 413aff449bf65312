"""Per-review features: text size, timing relative to the release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.columns import days_between, flag, text_length, word_count
from reviewloom.operators.summaries import summarise

# Length above which a text is extreme, upper day limits of the stages.
EXTREME_LENGTH = 8000
LIFECYCLE_STAGES = [
    ("First 30 days", 30),
    ("1-6 months", 180),
    ("6-12 months", 365),
    ("1-3 years", 1095),
]
MISSING_RELEASE, BEFORE_RELEASE, LAST_STAGE = "Missing release date", "Before release", "3+ years"


def text_features(df: DataFrame, column: str = "review", extreme: int = EXTREME_LENGTH) -> DataFrame:
    """Add length in code points, word count and the extreme-length flag."""
    return df.withColumns(
        {
            "review_length": text_length(F.col(column)),
            "review_word_count": word_count(F.col(column)),
        }
    ).withColumn("extreme_text", flag(F.col("review_length") > extreme))


def text_feature_stats(df: DataFrame) -> DataFrame:
    """Median length and word count, number of extreme texts, helpful rate."""
    medians = {"median_review_length": "review_length", "median_word_count": "review_word_count"}
    stats = summarise(
        df,
        [],
        {"helpful_review_rate": "received_helpful_vote"},
        medians,
        sums={"extreme_text_count": "extreme_text"},
    )
    return stats.select(*medians, "extreme_text_count", "helpful_review_rate")


def longest_texts(
    df: DataFrame, tie_break: str, column: str = "review", k: int = 10, preview: int = 200
) -> DataFrame:
    """The ``k`` longest texts with their sizes and a preview of their start.

    Texts are ranked by length alone; words are counted for the ``k`` winners only.
    """
    winners = (
        df.withColumn("review_length", text_length(F.col(column)))
        .orderBy(F.desc_nulls_last("review_length"), tie_break)
        .limit(k)
    )
    return winners.withColumns(
        {
            "review_word_count": word_count(F.col(column)),
            "review_preview": F.left(F.col(column), F.lit(preview)),
        }
    ).drop(column)


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` with a known key; a query that reads a repeated key fails, naming it.

    The check is part of the plan, in the key itself, so it costs no job of its own and
    no use of the key can skip it.
    """
    message = F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string"))
    checked = F.when(F.col("_rows") > 1, F.raise_error(message)).otherwise(F.col(key))
    others = [c for c in df.columns if c != key]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in others])
        .select(*[checked.alias(key) if c == key else F.col(c) for c in df.columns])
    )


def join_games(reviews: DataFrame, games: DataFrame) -> DataFrame:
    """Reviews with the columns of their game; reviews of unknown games are kept.

    A repeated game would multiply its reviews in every count, so the join refuses it.
    It has no hint: Spark broadcasts the catalogue if its size allows it, and otherwise
    shuffles and splits the partitions of games with very many reviews.
    """
    dimension = one_row_per_key(games.withColumnRenamed("appID", "appid"), "appid")
    if "name" in dimension.columns:
        dimension = dimension.withColumnRenamed("name", "game_name")
    return reviews.join(dimension, "appid", "left")


def add_lifecycle(reviews: DataFrame, games: DataFrame) -> DataFrame:
    """Join release dates and add day lag, before-release flag and lifecycle stage."""
    joined = join_games(reviews, games).withColumn(
        "days_since_release", days_between(F.col("review_date"), F.col("release_date"))
    )
    return add_lifecycle_stage(joined)


def add_lifecycle_stage(df: DataFrame, days: str = "days_since_release") -> DataFrame:
    """Before-release flag and stage of a day lag; an unknown lag has its own stage."""
    lag = F.col(days)
    stage = F.when(lag.isNull(), MISSING_RELEASE).when(lag < 0, BEFORE_RELEASE)
    for name, last_day in LIFECYCLE_STAGES:
        stage = stage.when(lag <= last_day, name)
    return df.withColumns(
        {"before_release": flag(lag < 0), "lifecycle_group": stage.otherwise(LAST_STAGE)}
    )
