"""Shape of the physical plans: pruning, reuse, skew, no Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from reviewloom.operators import clean, features, network, summaries
from reviewloom.plans import standins


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan AQE ended with; scalar subqueries that were reused appear as such."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def scanned(text: str) -> list[set[str]]:
    found = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    return [{re.sub(r"#\d+L?$", "", c) for c in columns.split(",")} for columns in found]


def records_read(spark, query, *args) -> int:
    """Input records of the stages that run to make a frame and to collect it.

    Tables that the query itself wrote and reads again are left out.
    """
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages() -> dict:
        context.listenerBus().waitUntilEmpty()
        empty = gateway.jvm.java.util.ArrayList()
        none = gateway.new_array(gateway.jvm.double, 0)
        found = context.statusStore().stageList(empty, False, False, none, empty)
        return {found.apply(i).stageId(): found.apply(i).inputRecords() for i in range(found.size())}

    before = stages()
    df = query(*args)
    made = sum(n for stage, n in stages().items() if stage not in before)
    before = stages()
    df.collect()
    collected = sum(n for stage, n in stages().items() if stage not in before)
    return made or collected


def records_shuffled(spark, run) -> int:
    """Records that the stages of ``run`` write to shuffles."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def written() -> int:
        context.listenerBus().waitUntilEmpty()
        empty = gateway.jvm.java.util.ArrayList()
        none = gateway.new_array(gateway.jvm.double, 0)
        found = context.statusStore().stageList(empty, False, False, none, empty)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = written()
    run()
    return written() - before


def test_scans_read_only_needed_columns(spark, sf_dir):
    df = contract.queries()["game_monthly_reviews"](spark, sf_dir)
    needed = {"l_partkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linenumber", "l_linestatus"}
    scans = scanned(plan(df))
    assert scans and all(columns <= needed for columns in scans)


def test_language_filter_reaches_the_scan(spark, sf_dir):
    df = contract.queries()["filter_language_quantiles"](spark, sf_dir)
    assert "EqualTo(lang,en)" in plan(df)


@pytest.mark.parametrize(
    ("name", "tables"),
    [
        ("playtime_cut_points", ["lineitem"]),
        ("playtime_quantiles", ["lineitem"]),
        ("playtime_quartile_summary", ["lineitem"]),
        ("playtime_quartile_summary_continuous", ["lineitem"]),
        ("playtime_quartile_summary_unlabelled_nulls", ["lineitem"]),
        ("game_monthly_reviews", ["lineitem"]),
        ("game_review_summary", ["lineitem"]),
        ("lifecycle_summary", ["lineitem", "orders"]),
        ("text_feature_stats", ["documents", "labels"]),
        ("describe_numeric", ["documents", "labels"]),
    ],
)
def test_quantiles_and_rates_read_their_input_once(spark, sf_dir, name, tables):
    rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in tables)
    assert records_read(spark, contract.queries()[name], spark, sf_dir) == rows


def test_both_rollups_read_the_reviews_once(spark, sf_dir):
    reviews = features.text_features(clean.clean_reviews(standins.lineitem_reviews(spark, sf_dir)))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    made = []
    assert records_read(spark, lambda: made.extend(summaries.rollup_report(reviews)) or made[0]) == rows
    for query, found in zip(("game_review_summary", "game_monthly_reviews"), made):
        expected = contract.queries()[query](spark, sf_dir)
        for df in (expected, found):
            assert "lineitem" not in plan(found)
        by_key = lambda df: sorted(
            (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr
        )
        assert by_key(found) == by_key(expected)


def test_small_groups_are_shuffled_once_after_their_histogram(spark):
    """Many games of a review or two a month: the histogram, its bins, and one sort."""
    rows = 40000
    reviews = spark.range(0, rows, 1, 4).selectExpr(
        "id div 4 AS appid",
        "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(25 * (id % 4)) AS review_date",
        "double(id % 50) AS playtime_hours_at_review",
        "id % 2 AS voted_up",
        "id % 3 AS received_helpful_vote",
        "0L AS written_during_early_access",
    )
    months = summaries.game_monthly_reviews(reviews)
    assert records_shuffled(spark, months.collect) <= 3 * rows


def test_lag_stats_join_once(spark, sf_dir):
    text = final_plan(contract.queries()["days_since_release_stats"](spark, sf_dir))
    assert len(scanned(text)) == 2


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(contract.queries()[name](spark, sf_dir))
    for operator in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


def test_small_catalogue_is_broadcast_and_large_one_is_not(spark, sf_dir):
    reviews = clean.clean_reviews(standins.lineitem_reviews(spark, sf_dir, appid="l_orderkey"))
    games = clean.clean_games(standins.order_games(spark, sf_dir)).select("appID", "release_date")
    joined = features.add_lifecycle(reviews, games)
    assert "BroadcastHashJoin" in final_plan(joined.select("appid", "lifecycle_group"))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        text = final_plan(features.add_lifecycle(reviews, games).select("appid", "lifecycle_group"))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_hot_game_is_split_when_the_catalogue_is_shuffled(spark, tmp_path):
    """One game holds a third of the reviews; AQE cuts its partition into several tasks."""
    rows = spark.range(0, 300000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("appid"),
        F.expr("timestamp_ntz '2020-01-01 00:00:00'").alias("review_date"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    rows.write.parquet(f"{tmp_path}/reviews")
    games = spark.range(300000).select(
        F.col("id").alias("appID"), F.expr("date '2019-01-01'").alias("release_date")
    )
    with settings(
        spark,
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        },
    ):
        joined = features.add_lifecycle(spark.read.parquet(f"{tmp_path}/reviews"), games)
        text = final_plan(joined.groupBy("lifecycle_group").agg(F.max("payload")))
    assert "SortMergeJoin(skew=true)" in text


def test_pairs_are_made_from_distinct_lists(spark):
    """The pairs come after the lists are counted, and no entity is shuffled by key."""
    games = spark.createDataFrame([(1, ["A", "B"])], "appID bigint, genres array<string>")
    text = plan(network.list_edges(games))
    assert "Join" not in text
    assert text.index("Generate explode") < text.index("hashpartitioning(_list")


class settings:
    def __init__(self, spark, values):
        self.spark, self.values = spark, values

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.values}
        for key, value in self.values.items():
            self.spark.conf.set(key, value)

    def __exit__(self, *_):
        for key, value in self.before.items():
            if value is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, value)
