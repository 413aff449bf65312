"""Profiles and audits of tables and joins. Each makes one pass over its input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.columns import lenient_number
from reviewloom.functions.frames import merge_by_key
from reviewloom.functions.quantiles import ROWS, VALUE, sliced_quantiles, value_histogram


def _is_missing(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _per_column(one_row: DataFrame, entries: list[Column]) -> DataFrame:
    """Turn the columns of a one-row aggregate into one row per profiled column."""
    return one_row.select(F.inline(F.array(*entries)))


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, rows, missing values (null or NaN)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_is_missing(df, f.name)).alias(f"_n{i}") for i, f in enumerate(df.schema)],
    )
    return _per_column(
        counts,
        [
            F.struct(
                F.lit(i + 1).cast("bigint").alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col("_rows").alias("row_count"),
                F.col(f"_n{i}").alias("null_count"),
            )
            for i, f in enumerate(df.schema)
        ],
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values (null or NaN) per column."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(_is_missing(df, c)).alias(f"_n{i}") for i, c in enumerate(columns)])
    return _per_column(
        counts,
        [
            F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("null_count"))
            for i, c in enumerate(columns)
        ],
    )


def binary_domain_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zeros, ones, missing and other values per column."""
    aggregates = []
    for i, name in enumerate(columns):
        column, missing = F.col(name), _is_missing(df, name)
        aggregates += [
            F.count_if(column == 0).alias(f"_zero{i}"),
            F.count_if(column == 1).alias(f"_one{i}"),
            F.count_if(missing).alias(f"_null{i}"),
            F.count_if(~missing & ~column.isin(0, 1)).alias(f"_other{i}"),
        ]
    return _per_column(
        df.agg(*aggregates),
        [
            F.struct(
                F.lit(name).alias("column_name"),
                F.col(f"_zero{i}").alias("zeros"),
                F.col(f"_one{i}").alias("ones"),
                F.col(f"_null{i}").alias("nulls"),
                F.col(f"_other{i}").alias("other_values"),
            )
            for i, name in enumerate(columns)
        ],
    )


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; null is not a value."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column)
    )
    return counts if k is None else counts.limit(k)


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, least value, exact quartiles and greatest value.

    Moments and quartiles are read off one histogram, so the input is read once.
    """
    each = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_in"))
        for c in columns
    ]
    hist = value_histogram(df.select(F.inline(F.array(*each))), F.col("_in"), ["column_name"])
    known = F.sum(F.when(F.col(VALUE).isNotNull(), F.col(ROWS)))
    mean = F.sum(F.col(VALUE) * F.col(ROWS)) / known
    # One mean per profiled column; deviations are taken from it, not from zero.
    means = hist.groupBy("column_name").agg(mean.alias("mean"))
    means = means.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "mean"))))
    off = F.col(VALUE) - means.scalar()[F.col("column_name")]
    basics = hist.groupBy("column_name").agg(
        F.coalesce(known, F.lit(0)).alias("count"),
        mean.alias("mean"),
        F.sqrt(F.sum(off * off * F.col(ROWS)) / F.nullif(known - 1, F.lit(0))).alias("std"),
        F.min(VALUE).alias("min"),
        F.max(VALUE).alias("max"),
    )
    quarters = sliced_quantiles(hist, [0.25, 0.5, 0.75], ["column_name"]).withColumnsRenamed(
        {"_q0": "q25", "_q1": "q50", "_q2": "q75"}
    )
    return merge_by_key(["column_name"], basics, quarters).select(
        "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def key_profile(df: DataFrame, key: str) -> DataFrame:
    """Distinct values, least and greatest value of a key, and strings that are no number."""
    number = lenient_number(F.col(key)) if _is_string(df, key) else F.col(key)
    # One row per key before the exact distinct count.
    per_key = df.groupBy(F.col(key).alias("_raw"), number.alias("_key")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return per_key.groupBy("_key").agg(
        F.sum(F.when(F.col("_key").isNull() & F.col("_raw").isNotNull(), F.col("_n"))).alias("_bad")
    ).agg(
        F.count("_key").alias("unique_keys"),
        F.min("_key").alias("min_key"),
        F.max("_key").alias("max_key"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("parse_failures"),
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their rows; null is no key."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def _is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def list_population(df: DataFrame, columns: Sequence[str], total: str = "total_games") -> DataFrame:
    """Rows, and rows with a non-empty list for every list column."""
    return df.agg(
        F.count(F.lit(1)).alias(total),
        *[F.count_if(F.size(F.col(c)) > 0).alias(f"games_with_{c}") for c in columns],
    )


def join_audit(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Fact rows, rows without a partner, and the share with one.

    Fact rows are counted per key before the join, so a key with very many rows
    is one row in it, and repeated dimension keys do not multiply rows.
    """
    per_key = fact.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = dimension.select(F.col(key).alias("_known")).distinct()
    matched = F.col("_known").isNotNull()
    return (
        per_key.join(known, F.col(key) == F.col("_known"), "left")
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.when(~matched, F.col("_n"))), F.lit(0)).alias("unmatched_rows"),
        )
        .withColumn(
            "coverage",
            1 - F.col("unmatched_rows") / F.nullif(F.col("total_rows"), F.lit(0)),
        )
    )


def unmatched_rows(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Fact rows without a partner in the dimension."""
    return fact.join(dimension.select(key), key, "left_anti")
