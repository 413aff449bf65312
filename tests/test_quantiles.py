"""Exact quantiles against numpy and against each other."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.functions import quantiles
from reviewloom.functions.quantiles import VALUE, _digits, sliced_quantiles, value_histogram
from reviewloom.operators.buckets import bucket_by_quantiles, quantile_report

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def _values(kind: str) -> list[float]:
    rng = np.random.default_rng(7)
    drawn = {
        "ties": rng.integers(0, 5, 501).astype(float),
        "tail": rng.lognormal(3, 3, 800),
        "signed": rng.normal(0, 1000, 777),
        "narrow": 1.7e9 + rng.random(400) / 1000,
        "single": np.array([3.5]),
        "tiny": rng.normal(0, 1e-9, 300),
    }[kind]
    return [float(v) for v in drawn]


def _nearest(values, prob):
    ordered = sorted(values)
    return ordered[int(np.floor((len(ordered) - 1) * prob + 0.5))]


@pytest.mark.parametrize("kind", ["ties", "tail", "signed", "narrow", "single", "tiny"])
def test_quantiles_agree_with_numpy(spark, kind):
    values = _values(kind)
    df = spark.createDataFrame([(v, "a") for v in values] + [(None, "a")], "v double, k string")
    for interpolation in ("linear", "nearest"):
        if interpolation == "linear":
            expected = np.quantile(values, PROBS)
        else:
            expected = [_nearest(values, p) for p in PROBS]
        hist = value_histogram(df, F.col("v"), ["k"])
        whole = sliced_quantiles(value_histogram(df, F.col("v")), PROBS, [], interpolation)
        by_key = sliced_quantiles(hist, PROBS, ["k"], interpolation).drop("k")
        for found in (whole, by_key):
            assert list(found.first()) == pytest.approx(list(expected), rel=1e-12)


def test_groups_with_null_key_and_null_values(spark):
    rows = [(None, 1.0), (None, 3.0), ("x", 5.0), ("x", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    hist = value_histogram(df, F.col("v"), ["k"])
    sliced = {r.k: r._q0 for r in sliced_quantiles(hist, [0.5], ["k"]).collect()}
    assert sliced == {None: 2.0, "x": 5.0, "empty": None}


def test_nearest_rounds_half_up(spark):
    # 391 rows at 0.75: rank 292.5, which goes to 293.
    df = spark.range(391).withColumn("v", F.col("id").cast("double"))
    row = quantile_report(df, "v", {"q": 0.75}, interpolation="nearest").first()
    assert row.q == 293.0


def test_nan_is_left_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (4.0,)], "v double")
    row = quantile_report(df, "v", {"q": 0.5}, extremes=True).first()
    assert (row.min, row.q, row.max) == (1.0, 2.0, 4.0)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantile_report(df, "v", {"q": 0.5}, extremes=True).first().asDict() == {
        "q": None,
        "min": None,
        "max": None,
    }


def test_tied_cut_points_leave_a_bucket_empty(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 2, 3, 4]], "v double")
    counts = bucket_by_quantiles(df, "v", output="g").groupBy("g").count().collect()
    # Cut-points 1, 1 and 2.25: nothing is left for the second bucket.
    assert {r.g: r["count"] for r in counts} == {"Low": 5, "High": 1, "Very High": 2}


def test_null_goes_to_the_last_bucket_or_to_none(spark):
    rows = [(v,) for v in [1.0, 2.0, 3.0, 4.0, None]]
    df = spark.createDataFrame(rows, "v double")
    last = bucket_by_quantiles(df, "v", output="g").where("v is null").first().g
    none = bucket_by_quantiles(df, "v", output="g", null_bucket=False).where("v is null").first().g
    assert (last, none) == ("Very High", None)


def test_labels_must_fit(spark):
    with pytest.raises(ValueError):
        bucket_by_quantiles(spark.range(3), "id", probs=[0.5])
    with pytest.raises(ValueError):
        quantile_report(spark.range(3), "id", {"q": 0.5}, interpolation="other")


@pytest.mark.parametrize(
    "column",
    [
        "id / 3e9",
        "1700000000 + pmod(id, 86400)",
        "if(id % 3 = 0, 7, id)",
        "if(id = 5, 0, 1700000000 + pmod(id * 7919, 86400))",
        "if(id = 5, -1e6, 100 + id / 3e5)",
        "if(id = 5, 1e300, -100 - id / 3e5)",
    ],
)
def test_no_cell_holds_much_of_a_column(spark, column):
    """Narrow columns, a value of a third of the rows, and one outlier below or above."""
    df = spark.range(300000).selectExpr(f"double({column}) AS v")
    hist = value_histogram(df, F.col("v"))
    coarse, fine = _digits(F.col(VALUE))
    hist_size = hist.count()
    cells = hist.groupBy(coarse.alias("coarse"), fine.alias("fine")).count()
    # What a task sorts: the values of one cell, and the cells of one coarse digit.
    assert cells.agg(F.max("count")).first()[0] < hist_size / 100
    assert cells.groupBy("coarse").count().agg(F.max("count")).first()[0] <= 1 << 14
    expected = df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5)))).first()[0]
    found = sliced_quantiles(hist, [0.25, 0.5]).first()
    assert list(found) == pytest.approx(expected, rel=1e-12)


def test_digits_never_fall(spark):
    rng = np.random.default_rng(3)
    values = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf")]
    values += [float(np.nextafter(2.0**i, 0)) for i in range(-1070, 1024, 31)]
    values += [2.0**i for i in range(-1074, 1024, 31)]
    values += [float(v) for v in 10.0 ** rng.uniform(-300, 300, 300)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    coarse, fine = _digits(F.col("v"))
    rows = df.select("v", coarse.alias("coarse"), fine.alias("fine")).collect()
    digits = [(r.coarse, r.fine) for r in sorted(rows, key=lambda r: r.v)]
    assert digits == sorted(digits)
    ours = sliced_quantiles(value_histogram(df, F.col("v")), [0.1, 0.5, 0.9], interpolation="nearest")
    ordered = sorted(values)
    assert list(ours.first()) == [_nearest(ordered, p) for p in (0.1, 0.5, 0.9)]


def test_exact_types_stay_exact(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big,), (big,), (big + 2,)], "v bigint")
    nearest = quantile_report(df, "v", {"q": 0.5}, interpolation="nearest", extremes=True).first()
    assert (nearest.min, nearest.q, nearest.max) == (big, big, big + 2)
    linear = quantile_report(df, "v", {"low": 0.0, "middle": 0.5, "high": 0.75}).first()
    assert (linear.low, linear.middle, linear.high) == (big, big, big + 1)
    wide = Decimal("12345678901234567890123456789012345678")
    df = spark.createDataFrame([(wide,)] * 3, "v decimal(38,0)")
    for interpolation in ("nearest", "linear"):
        assert quantile_report(df, "v", {"q": 0.5}, interpolation).first().q == wide


def test_sums_cover_rows_without_a_value(spark):
    rows = [("a", 1.0, 1), ("a", None, 1), ("a", 3.0, None), ("b", None, 0), (None, 2.0, 5)]
    df = spark.createDataFrame(rows, "k string, v double, s int")
    hist = value_histogram(df, F.col("v"), ["k"], [F.sum("s").alias("s")])
    found = sliced_quantiles(hist, [0.5], ["k"], totals=["_rows", "s"]).collect()
    assert {r.k: (r._q0, r._rows, r.s) for r in found} == {
        "a": (2.0, 3, 2),
        "b": (None, 1, 0),
        None: (2.0, 1, 5),
    }


@pytest.mark.parametrize("interpolation", ["linear", "nearest"])
def test_groups_in_full_bins_are_not_sorted_whole(spark, monkeypatch, interpolation):
    """One group over the bound, a null one, one without values, and many small ones."""
    monkeypatch.setattr(quantiles, "_WHOLE_ROWS", 100)
    monkeypatch.setattr(quantiles, "_BINS", 64)
    whole = []
    plain = quantiles._sorted
    monkeypatch.setattr(quantiles, "_sorted", lambda h, *a: whole.append(h) or plain(h, *a))
    rng = np.random.default_rng(11)
    groups = {"large": [float(v) for v in rng.lognormal(3, 3, 5000)], None: [1.0, 4.0, 4.0]}
    groups |= {f"g{i}": [float(v) for v in rng.integers(0, 9, 1 + i % 7)] for i in range(300)}
    rows = [(k, v, 1) for k, values in groups.items() for v in values]
    rows += [("empty", None, 1), ("large", None, 1), ("g5", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, s int")
    hist = value_histogram(df, F.col("v"), ["k"], [F.sum("s").alias("s")])
    found = sliced_quantiles(hist, [0.5, 0.9], ["k"], interpolation, ["_rows", "s"])
    found = {r.k: r for r in found.collect()}
    assert set(found) == {*groups, "empty"}
    for key, values in groups.items():
        if interpolation == "linear":
            expected = np.quantile(values, [0.5, 0.9])
        else:
            expected = [_nearest(values, p) for p in (0.5, 0.9)]
        row, size = found[key], len(values) + (key in ("large", "g5"))
        assert (row._q0, row._q1) == pytest.approx(tuple(expected), rel=1e-12)
        assert (row._rows, row.s) == (size, size)
    assert tuple(found["empty"]) == ("empty", None, None, 1, 1)
    sizes = {r.k: r["count"] for r in whole[0].groupBy("k").count().collect()}
    assert "large" not in sizes and max(sizes.values()) <= 100 and len(sizes) > 150
