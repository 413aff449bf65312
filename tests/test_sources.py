"""Scans, contract checks and sinks."""

from __future__ import annotations

import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.operators.clean import clean_reviews
from reviewloom.operators.quality import list_population
from reviewloom.sources.contracts import GAMES, REVIEWS, ContractError, check_columns, check_footers
from reviewloom.sources.files import scan_parquet, write_csv, write_parquet

CONTRACT = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_contract_accepts_any_number(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, b string")
    assert check_columns(df, CONTRACT) is df
    with pytest.raises(ContractError, match="b: string expected, missing"):
        check_columns(df.select("a"), CONTRACT)
    with pytest.raises(ContractError, match="a: number expected, string"):
        check_columns(df.select(F.lit("1").alias("a"), "b"), CONTRACT)


def test_columns_that_are_passed_through_may_have_any_type(spark, sf_dir, tmp_path):
    from reviewloom.plans import standins

    raw = standins.lineitem_reviews(spark, sf_dir)
    scores = raw.withColumn("weighted_vote_score", F.col("weighted_vote_score").cast("string"))
    check_columns(scores, REVIEWS)
    scores.write.parquet(f"{tmp_path}/r")
    check_footers(spark, spark.read.parquet(f"{tmp_path}/r").inputFiles(), REVIEWS)
    with pytest.raises(ContractError, match="weighted_vote_score: any expected, missing"):
        check_columns(raw.drop("weighted_vote_score"), REVIEWS)


def test_stand_ins_follow_the_contracts(spark, sf_dir):
    from reviewloom.plans import standins

    for make in (standins.lineitem_reviews, standins.document_reviews, standins.event_reviews):
        check_columns(make(spark, sf_dir), REVIEWS)
    check_columns(standins.order_games(spark, sf_dir), GAMES)


def test_a_column_missing_from_one_file_is_found(spark, tmp_path):
    pq.write_table(pa.table({"a": [1, 2], "b": ["x", "y"]}), tmp_path / "part1.parquet")
    pq.write_table(pa.table({"a": [3]}), tmp_path / "part2.parquet")
    path = f"{tmp_path}/*.parquet"
    assert scan_parquet(spark, path, ["a"], CONTRACT).count() == 3
    with pytest.raises(ContractError, match="part2.parquet: b should be string, is missing"):
        scan_parquet(spark, path, contract=CONTRACT, check_files=True)
    check_footers(spark, [f"file://{tmp_path}/part1.parquet"], CONTRACT)


def test_list_of_nulls_can_be_read(spark, tmp_path):
    table = pa.table(
        {"appID": ["1", "2"], "tags": pa.array([[], []], pa.list_(pa.null()))}
    )
    pq.write_table(table, tmp_path / "games.parquet")
    df = scan_parquet(spark, f"{tmp_path}/games.parquet")
    assert list_population(df, ["tags"]).first().games_with_tags == 0


def test_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.1), (2, "x", 1 / 3)], "a bigint, b string, c double")
    write_parquet(df, f"{tmp_path}/t", single_file=True)
    assert len(glob.glob(f"{tmp_path}/t/*.parquet")) == 1
    assert sorted(map(tuple, scan_parquet(spark, f"{tmp_path}/t").collect())) == sorted(
        map(tuple, df.collect())
    )
    write_parquet(df, f"{tmp_path}/p", partition_by=["a"])
    pruned = scan_parquet(spark, f"{tmp_path}/p", ["a", "c"]).where("a = 2")
    assert [tuple(r) for r in pruned.collect()] == [(2, 1 / 3)]
    plan = pruned._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(a" in plan


def test_csv_has_header_empty_nulls_and_full_precision(spark, tmp_path):
    df = spark.createDataFrame([(None, 0, 186.26666666666665)], "f bigint, g bigint, h double")
    write_csv(df, f"{tmp_path}/c")
    (file,) = glob.glob(f"{tmp_path}/c/*.csv")
    with open(file) as handle:
        assert handle.read() == "f,g,h\n,0,186.26666666666665\n"


def _review_file(path, rows: int, **types) -> None:
    """Raw reviews with one column in another type; the values are the row's number."""
    columns = {}
    for field in REVIEWS:
        text = isinstance(field.dataType, T.StringType)
        kind = types.get(field.name, pa.string() if text else pa.float64())
        values = [str(i) if text else i % 2 for i in range(rows)]
        if pa.types.is_null(kind):
            columns[field.name] = pa.nulls(rows)
        elif pa.types.is_dictionary(kind):
            columns[field.name] = pa.array(values).dictionary_encode()
        elif pa.types.is_string(kind):
            columns[field.name] = pa.array([str(v) for v in values])
        else:
            columns[field.name] = pa.array(values, kind)
    pq.write_table(pa.table(columns), path)


@pytest.mark.parametrize("first", ["a", "z"])
def test_files_of_different_physical_types_are_one_table(spark, tmp_path, first):
    """Integers next to doubles in both orders of the files, dictionaries, empty columns."""
    _review_file(tmp_path / "m 1%.parquet", 4)
    _review_file(
        tmp_path / f"{first}.parquet",
        6,
        appid=pa.int64(),
        voted_up=pa.int8(),
        votes_up=pa.decimal128(10, 2),
        timestamp_created=pa.float32(),
        language=pa.dictionary(pa.int32(), pa.string()),
        weighted_vote_score=pa.string(),
        received_for_free=pa.null(),
    )
    _review_file(tmp_path / "n.parquet", 5, appid=pa.int64(), game=pa.null())
    raw = scan_parquet(spark, f"{tmp_path}/*.parquet", contract=REVIEWS, check_files=True)
    assert raw.columns == REVIEWS.names
    assert dict(raw.dtypes)["appid"] == "double" and dict(raw.dtypes)["weighted_vote_score"] == "string"
    rows = clean_reviews(raw).collect()
    assert len(rows) == 15
    assert sorted(r.appid for r in rows) == sorted([i % 2 for n in (4, 6, 5) for i in range(n)])
    assert sum(r.voted_up for r in rows) == 2 + 3 + 2
    assert sum(r.received_for_free is None for r in rows) == 6
    assert sorted(r.language for r in rows) == sorted(str(i) for n in (4, 6, 5) for i in range(n))
    assert sum(r.game is None for r in rows) == 5


def test_one_scan_per_physical_schema(spark, tmp_path):
    for i in range(6):
        _review_file(tmp_path / f"{i}.parquet", 2, **({"appid": pa.int64()} if i % 2 else {}))
    raw = scan_parquet(spark, str(tmp_path), ["appid", "voted_up"], REVIEWS, check_files=True)
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "review" not in plan.split("Location")[0]
    assert raw.count() == 12


def test_a_column_of_another_kind_is_named(spark, tmp_path):
    _review_file(tmp_path / "good.parquet", 2)
    _review_file(tmp_path / "bad.parquet", 2, appid=pa.string())
    with pytest.raises(ContractError, match="bad.parquet: appid should be number, is string"):
        scan_parquet(spark, str(tmp_path), contract=REVIEWS, check_files=True)


def test_files_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    from reviewloom.sources import contracts

    _review_file(tmp_path / "a.parquet", 2)
    _review_file(tmp_path / "b.parquet", 3, appid=pa.int64())
    files = spark.read.parquet(str(tmp_path)).inputFiles()
    unopened = spark.createDataFrame([(f, None) for f in files], contracts.FOOTERS)
    monkeypatch.setattr(contracts, "footers", lambda *_: unopened)
    raw = scan_parquet(spark, str(tmp_path), contract=REVIEWS, check_files=True)
    assert raw.count() == 5 and dict(raw.dtypes)["appid"] == "double"
