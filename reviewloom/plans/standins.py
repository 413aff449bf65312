"""The driver's tables in the shape of raw reviews and of a raw catalogue.

Every stand-in carries the full raw contract, so a query runs the whole chain
from cleaning on. They read whole tables; missing values come from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.sources.files import scan_parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet")


def _number(column: Column) -> Column:
    return column.cast("double")


def _epoch_seconds(timestamp: str, has_time: bool = True) -> Column:
    moment = F.col(timestamp)
    seconds = F.unix_date(F.to_date(moment)).cast("bigint") * 86400
    if has_time:
        seconds = seconds + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    return seconds.cast("double")


def lineitem_reviews(
    spark: SparkSession,
    sf_dir: str,
    appid: str = "l_partkey",
    playtime: Column | str = "l_quantity",
) -> DataFrame:
    """Line items as reviews of parts or of orders."""
    playtime = F.col(playtime) if isinstance(playtime, str) else playtime
    return table(spark, sf_dir, "lineitem").select(
        _number(F.col(appid)).alias("appid"),
        F.concat(F.lit("Part "), F.col("l_partkey")).alias("game"),
        F.col("l_extendedprice").alias("author_playtime_forever"),
        playtime.alias("author_playtime_at_review"),
        F.lower("l_returnflag").alias("language"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string")).alias(
            "review"
        ),
        _epoch_seconds("l_shipdate", has_time=False).alias("timestamp_created"),
        _number(F.col("l_returnflag") != "R").alias("voted_up"),
        _number(F.col("l_linenumber") - 1).alias("votes_up"),
        F.col("l_discount").alias("weighted_vote_score"),
        _number(F.col("l_tax") > 0.04).alias("steam_purchase"),
        _number(F.col("l_discount") == 0).alias("received_for_free"),
        _number(F.col("l_linestatus") == "O").alias("written_during_early_access"),
    )


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews of their source; flags and votes are null if unlabelled."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        _number(F.substring("source", 4, 9)).alias("appid"),
        F.col("source").alias("game"),
        _number(F.col("n_chars")).alias("author_playtime_forever"),
        _number(F.col("n_chars")).alias("author_playtime_at_review"),
        F.col("lang").alias("language"),
        F.col("text").alias("review"),
        _number(F.col("doc_id") * 3600).alias("timestamp_created"),
        _number(F.col("quality")).alias("voted_up"),
        _number(F.col("quality") + F.col("toxic")).alias("votes_up"),
        F.lit(None).cast("double").alias("weighted_vote_score"),
        _number(F.col("quality")).alias("steam_purchase"),
        _number(F.col("toxic")).alias("received_for_free"),
        _number(F.col("toxic")).alias("written_during_early_access"),
    )


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviews by their user: few groups of many rows, times of day."""
    return table(spark, sf_dir, "events").select(
        _number(F.col("user_id")).alias("appid"),
        F.col("event_type").alias("game"),
        F.col("value").alias("author_playtime_forever"),
        F.col("value").alias("author_playtime_at_review"),
        F.col("event_type").alias("language"),
        F.col("props").alias("review"),
        _epoch_seconds("ts").alias("timestamp_created"),
        _number(F.col("event_type") != "error").alias("voted_up"),
        F.floor(F.col("value") / 50).cast("double").alias("votes_up"),
        F.lit(None).cast("double").alias("weighted_vote_score"),
        _number(F.col("event_type") == "purchase").alias("steam_purchase"),
        _number(F.col("event_type") == "view").alias("received_for_free"),
        _number(F.col("event_type") == "signup").alias("written_during_early_access"),
    )


def order_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a catalogue; pending orders have no day in their release date."""
    pending = F.col("o_orderstatus") == "P"
    floor = F.floor(F.col("o_totalprice") / 100000) * 100000
    owners = F.concat(floor, F.lit(" - "), floor + 100000)
    urgency = F.substring("o_orderpriority", 1, 1).cast("bigint")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("appID"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("name"),
        F.when(pending, F.date_format("o_orderdate", "MMM yyyy"))
        .otherwise(F.date_format("o_orderdate", "MMM d, yyyy"))
        .alias("release_date"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "0 - 0")
        .otherwise(owners)
        .alias("estimated_owners"),
        F.col("o_custkey").alias("peak_ccu"),
        F.col("o_totalprice").alias("price"),
        (urgency <= 2).alias("windows"),
        (urgency == 3).alias("mac"),
        (urgency >= 4).alias("linux"),
        urgency.alias("metacritic_score"),
        F.col("o_custkey").alias("positive"),
        urgency.alias("negative"),
        F.col("o_orderkey").alias("recommendations"),
        urgency.alias("average_playtime_forever"),
        urgency.alias("median_playtime_forever"),
        F.array(F.col("o_custkey").cast("string")).alias("developers"),
        F.array("o_orderstatus").alias("publishers"),
        F.split("o_orderpriority", "-").alias("categories"),
        F.when(pending, F.array().cast("array<string>"))
        .otherwise(F.array("o_orderstatus", "o_orderpriority"))
        .alias("genres"),
        F.array().cast("array<int>").alias("tags"),
    )


def part_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalogue whose genres are the words of the name and the type."""
    size = F.col("p_size")
    owners = F.concat(size * 1000, F.lit(" - "), size * 2000)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("appID"),
        F.col("p_name").alias("name"),
        F.when(size == 1, "0 - 0").otherwise(owners).alias("estimated_owners"),
        F.when(size > 25, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias(
            "categories"
        ),
        F.concat(F.split("p_name", " "), F.array("p_type")).alias("genres"),
        F.array().cast("array<int>").alias("tags"),
    )


def order_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types per order; an order can hold a type several times."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("genre"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("appID"), F.col("l_partkey").alias("p_partkey")
    )
    return lines.join(parts, "p_partkey").select("appID", "genre")
