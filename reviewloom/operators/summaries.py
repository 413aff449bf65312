"""Group summaries: row count, rates of 0/1 columns and exact medians.

Every summary reads its input once: counts, sums and medians come from one value
histogram, see ``functions.quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.columns import month_start
from reviewloom.functions.frames import merge_by_key
from reviewloom.functions.quantiles import (
    ROWS,
    VALUE,
    rolled_up,
    sliced_quantiles,
    value_histogram,
)
from reviewloom.operators.buckets import (
    PLAYTIME_LABELS,
    bucket_order,
    cut_points,
    label_by_cuts,
)
from reviewloom.sources.files import written

_MEASURE = "_measure"


def measure_histogram(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], summed: Sequence[str] = ()
) -> DataFrame:
    """One histogram for several columns, told apart by the key ``_measure``.

    The sums and the known values of the ``summed`` columns (``_sum_x``, ``_known_x``)
    stand with the first measure, so that they count every input row once.
    """
    summed = list(dict.fromkeys(summed))
    if len(measures) == 1:
        rows = df.select(*keys, *summed, F.col(measures[0]).alias("_in"), F.lit(0).alias(_MEASURE))
    else:
        each = [
            F.struct(F.lit(i).alias(_MEASURE), F.col(c).cast("double").alias("_in"))
            for i, c in enumerate(measures)
        ]
        rows = df.select(*keys, *summed, F.inline(F.array(*each)))
    own = {c: F.when(F.col(_MEASURE) == 0, F.col(c)) for c in summed}
    return value_histogram(rows, F.col("_in"), [*keys, _MEASURE], _sums(own))


def _sums(columns: dict[str, Column]) -> list[Column]:
    """Aggregates from which sums and rates of columns can be had, for any coarser group too."""
    return [F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{n}") for n, c in columns.items()] + [
        F.count(c).alias(f"_known_{n}") for n, c in columns.items()
    ]


def _parts(summed: Sequence[str]) -> list[str]:
    return [f"_{kind}_{c}" for c in dict.fromkeys(summed) for kind in ("sum", "known")]


def _rate(column: str) -> Column:
    return F.col(f"_sum_{column}") / F.nullif(F.col(f"_known_{column}"), F.lit(0))


def _total(column: str) -> Column:
    """Sum of a column, null without any known value."""
    return F.when(F.col(f"_known_{column}") > 0, F.col(f"_sum_{column}"))


def summarise_histogram(
    hist: DataFrame,
    keys: Sequence[str],
    rates: dict[str, str],
    medians: Sequence[str],
    count: str = "review_count",
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Count, rates, sums and exact medians per group of a ``measure_histogram``.

    ``medians`` names the result columns of its measures, in their order.
    """
    sums = sums or {}
    parts = _parts([*rates.values(), *sums.values()])
    if len(medians) == 1:
        found = sliced_quantiles(hist, [0.5], keys, totals=[ROWS, *parts])
        found = found.withColumn(medians[0], F.col("_q0").cast("double"))
    else:
        found = sliced_quantiles(hist, [0.5], [*keys, _MEASURE], totals=[ROWS, *parts])
        first = F.col(_MEASURE) == 0
        spread = [F.max(F.when(first, F.col(c))).alias(c) for c in [ROWS, *parts]]
        spread += [
            F.max(F.when(F.col(_MEASURE) == i, F.col("_q0"))).cast("double").alias(name)
            for i, name in enumerate(medians)
        ]
        found = found.groupBy(*keys).agg(*spread)
    return found.select(
        *keys,
        F.coalesce(F.col(ROWS), F.lit(0).cast("bigint")).alias(count),
        *[_rate(c).alias(name) for name, c in rates.items()],
        *[_total(c).alias(name) for name, c in sums.items()],
        *medians,
    )


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    rates: dict[str, str],
    medians: dict[str, str],
    count: str = "review_count",
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Count, rates, sums and exact medians for any number and size of groups, in one scan."""
    summed = [*rates.values(), *(sums or {}).values()]
    hist = measure_histogram(df, keys, list(medians.values()), summed)
    return summarise_histogram(hist, keys, rates, list(medians), count, sums)


def medians_by(df: DataFrame, keys: Sequence[str], medians: dict[str, str]) -> DataFrame:
    """Exact medians for any number and size of groups."""
    return summarise(df, keys, {}, medians, "_count").drop("_count")


def playtime_summary(
    reviews: DataFrame,
    playtime: str = "playtime_hours_at_review",
    labels: Sequence[str] = PLAYTIME_LABELS,
    null_bucket: bool = True,
    medians: dict[str, str] | None = None,
) -> DataFrame:
    """Reviews by playtime quartile: count, approval, median hours, helpful rate.

    Rows come in bucket order. ``medians`` adds the medians of further columns.
    Cut-points, rates and median hours come from one scan and one histogram
    of playtime, which this function computes; further medians read the reviews once more.
    """
    key = "playtime_group"
    rates = {name: _RATES[name] for name in ("approval_rate", "helpful_review_rate")}
    hist = written(measure_histogram(reviews, [], [playtime], rates.values()))
    cuts = cut_points(hist)

    def labelled(df: DataFrame, value: str) -> DataFrame:
        df = label_by_cuts(df, F.col(value), cuts, labels, key, null_bucket)
        return df if null_bucket else df.where(F.col(key).isNotNull())

    summary = summarise_histogram(labelled(hist, VALUE), [key], rates, ["median_playtime_hours"])
    if medians:
        more = medians_by(labelled(reviews, playtime), [key], medians)
        summary = merge_by_key([key], summary, more)
    summary = summary.select(*PLAYTIME_COLUMNS, *(medians or {}))
    # At most one row per label: one partition sorts them all.
    return summary.repartition(1).sortWithinPartitions(bucket_order(key, labels))


# Result columns in their published order.
PLAYTIME_COLUMNS = [
    "playtime_group",
    "review_count",
    "approval_rate",
    "median_playtime_hours",
    "helpful_review_rate",
]
LIFECYCLE_COLUMNS = ["lifecycle_group", *PLAYTIME_COLUMNS[1:], "early_access_share"]
GAME_COLUMNS = ["appid", *LIFECYCLE_COLUMNS[1:], "median_review_length"]
MONTH_COLUMNS = ["appid", "review_month", *LIFECYCLE_COLUMNS[1:]]

_RATES = {
    "approval_rate": "voted_up",
    "helpful_review_rate": "received_helpful_vote",
    "early_access_share": "written_during_early_access",
}


_HOURS = {"median_playtime_hours": "playtime_hours_at_review"}
_SIZES = {**_HOURS, "median_review_length": "review_length"}


def lifecycle_summary(joined: DataFrame) -> DataFrame:
    """Reviews by lifecycle stage: count, rates and median hours."""
    return summarise(joined, ["lifecycle_group"], _RATES, _HOURS).select(*LIFECYCLE_COLUMNS)


def lifecycle_report(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lifecycle summary and early-access cross-tab from a single scan and join.

    Both read one histogram, which this function computes.
    """
    flags = ["before_release", "written_during_early_access"]
    keys = ["lifecycle_group", *flags]
    hist = written(measure_histogram(joined, keys, list(_HOURS.values()), _RATES.values()))
    by_stage = rolled_up(hist, ["lifecycle_group", _MEASURE], _parts(_RATES.values()))
    summary = summarise_histogram(by_stage, ["lifecycle_group"], _RATES, list(_HOURS))
    crosstab = (
        hist.groupBy(*flags)
        .agg(F.sum(ROWS).alias("review_count"))
        .orderBy(*[F.asc_nulls_first(c) for c in flags])
    )
    return summary.select(*LIFECYCLE_COLUMNS), crosstab


def game_review_summary(reviews: DataFrame) -> DataFrame:
    """One row per game; needs ``review_length`` (see ``operators.features``)."""
    return summarise(reviews, ["appid"], _RATES, _SIZES).select(*GAME_COLUMNS)


def _with_month(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("review_month", month_start(F.col("review_date")))


def game_monthly_reviews(reviews: DataFrame) -> DataFrame:
    """One row per game and calendar month."""
    keys = ["appid", "review_month"]
    return summarise(_with_month(reviews), keys, _RATES, _HOURS).select(*MONTH_COLUMNS)


def rollup_report(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``game_review_summary`` and ``game_monthly_reviews`` from a single scan.

    Both read one histogram by game, month and value; added up over the
    months it is the histogram by game.
    """
    keys = ["appid", "review_month"]
    hist = written(
        measure_histogram(_with_month(reviews), keys, list(_SIZES.values()), _RATES.values())
    )
    by_game = rolled_up(hist, ["appid", _MEASURE], _parts(_RATES.values()))
    games = summarise_histogram(by_game, ["appid"], _RATES, list(_SIZES))
    hours = hist.where(F.col(_MEASURE) == 0)
    months = summarise_histogram(hours, keys, _RATES, list(_HOURS))
    return games.select(*GAME_COLUMNS), months.select(*MONTH_COLUMNS)


def lifecycle_counts(joined: DataFrame) -> DataFrame:
    """Reviews per lifecycle stage, most frequent first."""
    return (
        joined.groupBy("lifecycle_group")
        .agg(F.count(F.lit(1)).alias("review_count"))
        .orderBy(F.desc("review_count"), "lifecycle_group")
    )


def flag_crosstab(df: DataFrame, first: str, second: str, count: str = "review_count") -> DataFrame:
    """Rows per combination of two flags; unknown is a group of its own and sorts first."""
    return (
        df.groupBy(first, second)
        .agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.asc_nulls_first(first), F.asc_nulls_first(second))
    )


def lag_stats(joined: DataFrame, days: str = "days_since_release") -> DataFrame:
    """Least, median and greatest day lag and the number of negative ones."""
    hist = value_histogram(joined, F.col(days))
    early = F.sum(F.when(F.col(VALUE) < 0, F.col(ROWS)))
    ends = hist.agg(
        F.min(VALUE).cast("bigint").alias("min_days"),
        F.max(VALUE).cast("bigint").alias("max_days"),
        F.coalesce(early, F.lit(0)).alias("reviews_before_release"),
    )
    middle = sliced_quantiles(hist, [0.5]).select(F.col("_q0").cast("double").alias("median_days"))
    return merge_by_key([], ends, middle).select(
        "min_days", "median_days", "max_days", "reviews_before_release"
    )


def pre_release_games(joined: DataFrame) -> DataFrame:
    """Games with reviews before release: how many, how many in early access, how early."""
    return (
        joined.where(F.col("days_since_release") < 0)
        .groupBy("appid", "game_name", "release_date")
        .agg(
            F.count(F.lit(1)).alias("pre_release_reviews"),
            F.sum("written_during_early_access").alias("early_access_reviews"),
            F.min("days_since_release").alias("earliest_days_before_release"),
        )
        .orderBy(F.desc("pre_release_reviews"), "appid", "game_name", "release_date")
    )


def row_count(df: DataFrame, name: str) -> DataFrame:
    """Number of rows as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(name))
