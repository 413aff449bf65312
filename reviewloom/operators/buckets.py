"""Quantile buckets and quantile reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.frames import merge_by_key
from reviewloom.functions.quantiles import VALUE, sliced_quantiles, value_histogram

# Bucket labels, lowest first.
PLAYTIME_LABELS = ("Low", "Moderate", "High", "Very High")
QUARTILES = (0.25, 0.5, 0.75)


def bucket_by_quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float] = QUARTILES,
    labels: Sequence[str] = PLAYTIME_LABELS,
    output: str = "playtime_group",
    null_bucket: bool = True,
) -> DataFrame:
    """Label rows by the exact quantiles of a column.

    Equal values share a bucket: a value belongs to the first bucket whose
    upper cut-point it does not exceed, so buckets may differ in size or be
    empty. Null values go to the last bucket, or to none (null label) without
    ``null_bucket``.
    """
    if len(labels) != len(probs) + 1:
        raise ValueError("one label more than cut-points is needed")
    cuts = cut_points(value_histogram(df, F.col(column)), probs)
    return label_by_cuts(df, F.col(column), cuts, labels, output, null_bucket)


def cut_points(hist: DataFrame, probs: Sequence[float] = QUARTILES) -> Column:
    """Exact quantiles of a histogram as an array, for use in other frames.

    A scalar subquery: it runs once, within the query that uses it.
    """
    names = [f"_q{i}" for i in range(len(probs))]
    return sliced_quantiles(hist, probs).select(F.array(*names)).scalar()


def label_by_cuts(
    df: DataFrame,
    value: Column,
    cuts: Column,
    labels: Sequence[str] = PLAYTIME_LABELS,
    output: str = "playtime_group",
    null_bucket: bool = True,
) -> DataFrame:
    """Add the label of the first cut-point that is not exceeded, or the last label."""
    label = F.when(F.lit(not null_bucket) & value.isNull(), None)
    for i, name in enumerate(labels[:-1]):
        label = label.when(value <= F.col("_cuts")[i], name)
    return (
        df.withColumn("_cuts", cuts)
        .withColumn(output, label.otherwise(labels[-1]))
        .drop("_cuts")
    )


def bucket_order(column: str, labels: Sequence[str] = PLAYTIME_LABELS) -> Column:
    """Position of a label, for sorting; unknown labels sort with the last one."""
    order = F
    for i, name in enumerate(labels[:-1]):
        order = order.when(F.col(column) == name, i + 1)
    return order.otherwise(len(labels))


def quantile_report(
    df: DataFrame,
    column: str,
    probs: dict[str, float],
    interpolation: str = "linear",
    extremes: bool = False,
) -> DataFrame:
    """One row with the named quantiles and, with ``extremes``, least and greatest value.

    Nearest quantiles and extremes have the type of the column. Interpolated ones are
    doubles, or decimals if the column holds whole numbers or decimals.
    """
    hist = value_histogram(df, F.col(column))
    report = sliced_quantiles(hist, list(probs.values()), interpolation=interpolation)
    report = report.withColumnsRenamed({f"_q{i}": name for i, name in enumerate(probs)})
    if not extremes:
        return report
    kind = df.schema[column].dataType
    ends = hist.agg(
        F.min(VALUE).cast(kind).alias("min"), F.max(VALUE).cast(kind).alias("max")
    )
    return merge_by_key([], report, ends)
