"""Exact quantiles that never gather a large group into one task.

Everything here starts from a *value histogram*: one row per (group, value)
with its number of input rows. It is built with map-side combining, so a value
or a group that holds a third of the table costs each map task one row per
distinct value. Quantiles are ranks, found in this histogram by descent through
digits that sort like the value: first a 1024th of a doubling, then the nearest
single-precision number. Totals of the first digit, combined before they are
shuffled, tell which cells hold a wanted rank; only these cells are split by the next
digit, and in the end only values equal in both are sorted. Digits follow from the
value alone, so no outlier can change how the other values are cut.

The descent shuffles the histogram several times. Groups that one task can sort do
without it: groups are counted in bins, and those of a bin with few rows are sorted
whole, in one shuffle. The rest, and a table without groups, take the descent.

Sums of further columns of the histogram, such as the parts of rates, are carried
through the totals: ranks and sums read the same shuffle of one scan.

Quantile columns are named ``_q0``, ``_q1``, ... in the order of ``probs``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.columns import nan_to_null

EXACT = (T.IntegralType, T.DecimalType)
VALUE = "_value"
ROWS = "_rows"

_DIGITS = ["_d0", "_d1"]
# Digits after the point of interpolated whole numbers.
_FRACTION = 10
# Rows of a bin whose groups are sorted whole, and number of bins. Neither changes
# results; the full bins are broadcast.
_WHOLE_ROWS = 1 << 16
_BINS = 1 << 16


def value_histogram(
    df: DataFrame,
    value: Column,
    keys: Sequence[str] = (),
    aggregates: Sequence[Column] = (),
) -> DataFrame:
    """One row per (keys, value): row count in ``_rows`` plus the given aggregates.

    NaN counts as null. Whole numbers and decimals keep their type.
    """
    kind = df.select(value.alias(VALUE)).schema[VALUE].dataType
    known = value if isinstance(kind, EXACT) else nan_to_null(value)
    return _as_one(
        df.groupBy(*keys, known.alias(VALUE)).agg(F.count(F.lit(1)).alias(ROWS), *aggregates)
    )


def rolled_up(hist: DataFrame, keys: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """The histogram of coarser groups: counts and the named sums added up."""
    sums = [F.sum(c).alias(c) for c in [ROWS, *parts]]
    return _as_one(hist.groupBy(*keys, VALUE).agg(*sums))


def _as_one(df: DataFrame) -> DataFrame:
    """The same rows, each passed on as a whole.

    Column pruning would otherwise give every use of a histogram its own version of
    the shuffle below, and a scan for each.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _ranks(prob: float, interpolation: str) -> tuple[str, str, str]:
    """SQL for the 0-based lower rank, upper rank and the weight of the upper value."""
    position = f"((_total - 1) * {float(prob)!r}D)"
    if interpolation == "linear":
        return f"floor{position}", f"ceil{position}", f"({position} - floor{position})"
    if interpolation == "nearest":
        rank = f"floor({position} + 0.5D)"
        return rank, rank, "0D"
    raise ValueError(f"unknown interpolation: {interpolation}")


def _holds(rank: str) -> str:
    return f"(_before <= {rank} AND {rank} < _before + _counted)"


def _wanted(probs: Sequence[float], interpolation: str) -> Column:
    """Whether a row holds one of the wanted ranks; without known values any row does."""
    ranks = {rank for prob in probs for rank in _ranks(prob, interpolation)[:2]}
    return F.expr(" OR ".join(["_total = 0", *(_holds(rank) for rank in sorted(ranks))]))


def _picks(probs: Sequence[float], interpolation: str, kind: T.DataType) -> list[Column]:
    """Aggregates that read the quantiles from ``_before``, ``_counted`` and ``_total``.

    The nearest value is taken as it is. Interpolation gives doubles, and decimals for
    whole numbers and decimals, so that a value between no two others stays exact.
    """
    picks = []
    for i, prob in enumerate(probs):
        low, high, weight = _ranks(prob, interpolation)
        at_low = f"max(CASE WHEN {_holds(low)} THEN {VALUE} END)"
        at_high = f"max(CASE WHEN {_holds(high)} THEN {VALUE} END)"
        if interpolation == "nearest":
            picks.append(F.expr(at_low).alias(f"_q{i}"))
            continue
        share = f"max({weight})"
        if isinstance(kind, EXACT):
            whole = kind.precision - kind.scale if isinstance(kind, T.DecimalType) else 19
            scale = kind.scale if isinstance(kind, T.DecimalType) else 0
            to = f"decimal(38,{max(scale, min(_FRACTION, 38 - whole))})"
            step = f"cast(({at_high} - {at_low}) * cast({share} as decimal(18,17)) as {to})"
            at_low = f"cast({at_low} as {to})"
            between = f"{at_low} + {step}"
        else:
            to = "double"
            between = f"{at_low} * (1 - {share}) + {at_high} * {share}"
        pick = f"CASE WHEN {share} = 0 THEN {at_low} ELSE {between} END"
        picks.append(F.expr(f"cast({pick} as {to})").alias(f"_q{i}"))
    return picks


def _so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _digits(value: Column) -> list[Column]:
    """Numbers that, compared in this order, never fall as the value rises.

    A 1024th of a doubling, with the sign, and the nearest single-precision number. Both
    only balance the work; results do not depend on them.
    """
    number = value.cast("double")
    step = F.floor(F.log2(F.abs(number)) * 1024 + (1 << 21))
    coarse = F.when(number < 0, -step).when(number > 0, step).when(number == 0, 0)
    return [coarse, number.cast("float")]


def sliced_quantiles(
    hist: DataFrame,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    interpolation: str = "linear",
    totals: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles per group, for any number and size of groups; nulls are left out.

    ``totals`` names columns of the histogram whose sums over all rows of the group,
    those of null values too, are added. Without keys there is always one row; a group
    of nulls alone has null quantiles.
    """
    keys, totals = list(keys), list(totals)
    if not keys:
        return _descended(hist, probs, keys, interpolation, totals)
    binned = hist.withColumn("_bin", F.pmod(F.xxhash64(*keys), F.lit(_BINS)).cast("int"))
    full = (
        binned.groupBy("_bin")
        .agg(F.count(F.lit(1)).alias("_size"))
        .where(F.col("_size") > _WHOLE_ROWS)
        .select("_bin")
    )
    rest = binned.join(F.broadcast(full), "_bin", "left_anti").drop("_bin")
    large = binned.join(F.broadcast(full), "_bin", "left_semi").drop("_bin")
    return _sorted(rest, probs, keys, interpolation, totals).unionByName(
        _descended(large, probs, keys, interpolation, totals)
    )


def _counted() -> Column:
    """Rows with a value that a row of the histogram stands for."""
    known = F.when(F.col(VALUE).isNotNull(), F.col(ROWS)).otherwise(F.lit(0).cast("bigint"))
    return known.alias("_counted")


def _sorted(
    hist: DataFrame,
    probs: Sequence[float],
    keys: list[str],
    interpolation: str,
    totals: list[str],
) -> DataFrame:
    """``sliced_quantiles`` of groups that one task can sort."""
    group = Window.partitionBy(*keys).orderBy(VALUE)
    every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = hist.select(*keys, VALUE, _counted(), *totals).withColumns(
        {
            "_before": F.sum("_counted").over(_so_far(group)) - F.col("_counted"),
            "_total": F.sum("_counted").over(every),
        }
    )
    picks = _picks(probs, interpolation, hist.schema[VALUE].dataType)
    return ranked.groupBy(*keys).agg(*picks, *[F.sum(c).alias(c) for c in totals])


def _descended(
    hist: DataFrame,
    probs: Sequence[float],
    keys: list[str],
    interpolation: str,
    totals: list[str],
) -> DataFrame:
    """``sliced_quantiles`` by descent through the digits, for groups of any size."""
    kind = hist.schema[VALUE].dataType
    digits = [c.alias(name) for c, name in zip(_digits(F.col(VALUE)), _DIGITS)]
    rows = hist.select(*keys, VALUE, _counted(), *digits, *totals)
    wanted = _wanted(probs, interpolation)

    group = Window.partitionBy(*(keys or [F.lit(0)]))
    sums = F.sum("_counted").alias("_counted")
    cells = rows.groupBy(*keys, _DIGITS[0]).agg(sums, *[F.sum(c).alias(c) for c in totals])
    running = F.sum("_counted").over(_so_far(group.orderBy(_DIGITS[0])))
    cells = cells.withColumns(
        {
            "_before": running - F.col("_counted"),
            "_total": F.sum("_counted").over(group),
            **{c: F.sum(c).over(group) for c in totals},
        }
    ).where(wanted)
    carried = ["_before", "_total", *totals]
    plain = rows.drop(*totals)

    def inside(cells: DataFrame, at: list[str]) -> DataFrame:
        """Rows of the wanted cells, with what their cell carries."""
        cells = cells.select(*[F.col(c).alias(f"_at{c}") for c in at], *carried)
        # Null-safe on every column: a plain equality would make the optimizer add
        # not-null filters on one side, and the histogram could not be reused.
        same = F.lit(True)
        for name in at:
            same = same & F.col(name).eqNullSafe(F.col(f"_at{name}"))
        # Without groups there are at most two cells a quantile; else Spark decides.
        return plain.join(cells if keys else F.broadcast(cells), same).drop(
            *[f"_at{c}" for c in at]
        )

    for depth in range(1, len(_DIGITS)):
        at = [*keys, *_DIGITS[:depth]]
        running = F.sum("_counted").over(_so_far(Window.partitionBy(*at).orderBy(_DIGITS[depth])))
        cells = (
            inside(cells, at)
            .groupBy(*at, _DIGITS[depth])
            .agg(sums, *[F.first(c).alias(c) for c in carried])
            .withColumn("_before", F.col("_before") + running - F.col("_counted"))
            .where(wanted)
        )
    at = [*keys, *_DIGITS]
    running = F.sum("_counted").over(_so_far(Window.partitionBy(*at).orderBy(VALUE)))
    return (
        inside(cells, at)
        .withColumn("_before", F.col("_before") + running - F.col("_counted"))
        .groupBy(*keys)
        .agg(*_picks(probs, interpolation, kind), *[F.first(c).alias(c) for c in totals])
    )
