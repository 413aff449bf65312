"""Tags of catalogue items: long form, counts and co-occurrence networks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.columns import grouped_digits
from reviewloom.functions.frames import merge_by_key
from reviewloom.operators.buckets import quantile_report

# Edge weights the network is cut at.
THRESHOLDS = (100, 500, 1000, 2500, 5000)
STRONG_EDGE = 2500

# Items per block: pairs are made block by block, so this bounds the pairs of a row.
BLOCK = 1024


def explode_list(
    df: DataFrame, keys: Sequence[str] = ("appID", "name"), column: str = "genres", item: str = "genre"
) -> DataFrame:
    """One row per list element; null lists, empty lists and null elements give none."""
    return df.select(*keys, F.explode(column).alias(item)).where(F.col(item).isNotNull())


def item_table_size(long: DataFrame, item: str = "genre") -> DataFrame:
    """Rows of the long table and number of distinct items."""
    return long.agg(
        F.count(F.lit(1)).alias(f"{item}_rows"), F.countDistinct(item).alias(f"unique_{item}s")
    )


def item_counts(long: DataFrame, item: str = "genre", k: int | None = None) -> DataFrame:
    """Rows per item, most frequent first; the top ``k`` if given."""
    counts = (
        long.groupBy(item)
        .agg(F.count(F.lit(1)).alias("game_count"))
        .orderBy(F.desc("game_count"), item)
    )
    return counts if k is None else counts.limit(k)


def cooccurrence_edges(
    long: DataFrame,
    key: str = "appID",
    item: str = "genre",
    weight: str = "shared_games",
    dedupe: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Unordered pairs of items of the same entity, with the number of joined rows.

    An item listed n times and a partner listed m times give n x m, or 1 with
    ``dedupe``. Repeats are counted first, so an entity with very many rows is
    reduced to its distinct items, and these are cut into blocks of about ``block``
    items. Entities with the same block, or pair of blocks, are counted together;
    pairs are made once per distinct block or pair of blocks.
    """
    listed = (
        long.where(F.col(key).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(key).alias("_key"), F.col(item).alias("_item"))
        .agg((F.lit(1).cast("bigint") if dedupe else F.count(F.lit(1))).alias("_times"))
    )
    sizes = listed.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    blocks = (
        listed.join(sizes, "_key")
        .groupBy("_key", "_blocks", F.expr("pmod(hash(_item), _blocks)").alias("_block"))
        .agg(F.sort_array(F.collect_list(F.struct("_item", "_times"))).alias("_basket"))
    )
    pairs = _pairs_within(blocks).unionByName(_pairs_across(blocks))
    return (
        pairs.groupBy(F.col("_item").alias(item), F.col("_item_2").alias(f"{item}_2"))
        .agg(F.sum("_weight").alias(weight))
        .orderBy(F.desc(weight), item, f"{item}_2")
    )


_WEIGHT = "_first._times * _second._times * _entities"


def _pairs_within(blocks: DataFrame) -> DataFrame:
    """Weighted pairs of items of the same block."""
    baskets = (
        blocks.where(F.size("_basket") > 1)
        .groupBy("_basket")
        .agg(F.count(F.lit(1)).alias("_entities"))
    )
    later = F.filter("_basket", lambda other: other["_item"] > F.col("_first._item"))
    return (
        baskets.select("_basket", "_entities", F.explode("_basket").alias("_first"))
        .select("_entities", "_first", F.explode(later).alias("_second"))
        .select(
            F.col("_first._item").alias("_item"),
            F.col("_second._item").alias("_item_2"),
            F.expr(_WEIGHT).alias("_weight"),
        )
    )


def _pairs_across(blocks: DataFrame) -> DataFrame:
    """Weighted pairs of items of different blocks of an entity; none if it has one block."""
    split = blocks.where("_blocks > 1")
    later = split.where("_block + 1 < _blocks").select(
        "_key",
        F.col("_basket").alias("_left"),
        F.explode(F.expr("sequence(_block + 1, _blocks - 1)")).alias("_block"),
    )
    both = (
        later.join(split.select("_key", "_block", F.col("_basket").alias("_right")), ["_key", "_block"])
        .groupBy("_left", "_right")
        .agg(F.count(F.lit(1)).alias("_entities"))
    )
    return (
        both.select("_right", "_entities", F.explode("_left").alias("_first"))
        .select("_entities", "_first", F.explode("_right").alias("_second"))
        .select(
            F.least("_first._item", "_second._item").alias("_item"),
            F.greatest("_first._item", "_second._item").alias("_item_2"),
            F.expr(_WEIGHT).alias("_weight"),
        )
    )


def list_edges(
    df: DataFrame,
    column: str = "genres",
    item: str = "genre",
    weight: str = "shared_games",
    block: int = BLOCK,
) -> DataFrame:
    """The same edges straight from a list column with one row per entity.

    Entities with the same list are counted first; pairs are made once per
    distinct list and weighted by its count, so neither the entities nor their
    pairs are shuffled. Sorted lists are cut into blocks, and pairs of blocks are
    spread over the tasks.
    """
    lists = (
        df.select(F.sort_array(F.array_compact(column)).alias("_list"))
        .where(F.size("_list") > 1)
        .groupBy("_list")
        .agg(F.count(F.lit(1)).alias("_entities"))
        .withColumn("_last", F.ceil(F.size("_list") / block).cast("int") - 1)
    )
    part = lambda number: F.slice("_list", F.col(number) * block + 1, F.lit(block))
    spread = (
        lists.withColumn("_i", F.explode(F.expr("sequence(0, _last)")))
        .withColumn("_j", F.explode(F.expr("sequence(_i, _last)")))
        .select("_entities", part("_i").alias("_left"), part("_j").alias("_right"))
        .repartition("_left", "_right")
    )
    later = F.filter("_right", lambda other: other > F.col(item))
    return (
        spread.select("_entities", "_right", F.explode("_left").alias(item))
        .select("_entities", item, F.explode(later).alias(f"{item}_2"))
        .groupBy(item, f"{item}_2")
        .agg(F.sum("_entities").alias(weight))
        .orderBy(F.desc(weight), item, f"{item}_2")
    )


def threshold_sweep(
    edges: DataFrame, thresholds: Sequence[int] = THRESHOLDS, weight: str = "shared_games"
) -> DataFrame:
    """Number of edges, and of edges at or above every threshold."""
    return edges.agg(
        F.count(F.lit(1)).alias("all_edges"),
        *[F.count_if(F.col(weight) >= t).alias(f"edges_{t}_plus") for t in thresholds],
    )


def edge_size(edges: DataFrame, weight: str = "shared_games") -> DataFrame:
    """Number of edges and greatest weight."""
    return edges.agg(
        F.count(F.lit(1)).alias("edge_count"), F.max(weight).alias(f"max_{weight}")
    )


def edge_stats(edges: DataFrame, weight: str = "shared_games") -> DataFrame:
    """Least, median, 0.75, 0.9 and greatest weight.

    The median interpolates; the two quantiles are the nearest actual weight.
    """
    stats = merge_by_key(
        [],
        quantile_report(edges, weight, {"median": 0.5}, extremes=True),
        quantile_report(edges, weight, {"q75": 0.75, "q90": 0.9}, interpolation="nearest"),
    )
    quantiles = [F.col(c).cast("double").alias(c) for c in ("median", "q75", "q90")]
    return stats.select("min", *quantiles, "max")


def strong_edges(
    edges: DataFrame, threshold: int = STRONG_EDGE, weight: str = "shared_games"
) -> DataFrame:
    """Edges at or above a weight."""
    return edges.where(F.col(weight) >= threshold)


def node_count(edges: DataFrame, item: str = "genre", name: str = "genres_in_network") -> DataFrame:
    """Number of distinct items at either end of an edge."""
    return edges.select(F.explode(F.array(item, f"{item}_2")).alias("_node")).agg(
        F.countDistinct("_node").alias(name)
    )


def network_nodes(long: DataFrame, edges: DataFrame, item: str = "genre", unit: str = "games"):
    """Nodes of the network: id, label, title such as ``Action: 46,743 games``, value."""
    ends = edges.select(F.explode(F.array(item, f"{item}_2")).alias(item)).distinct()
    counts = long.groupBy(item).agg(F.count(F.lit(1)).alias("value"))
    return counts.join(ends, item, "left_semi").select(
        F.col(item).alias("id"),
        F.col(item).alias("label"),
        F.concat(F.col(item), F.lit(": "), grouped_digits(F.col("value")), F.lit(f" {unit}")).alias(
            "title"
        ),
        "value",
    )


def network_edges(
    edges: DataFrame, item: str = "genre", weight: str = "shared_games", unit: str = "shared games"
) -> DataFrame:
    """Edges of the network: from, to, title such as ``38,926 shared games``, value."""
    return edges.select(
        F.col(item).alias("from"),
        F.col(f"{item}_2").alias("to"),
        F.concat(grouped_digits(F.col(weight)), F.lit(f" {unit}")).alias("title"),
        F.col(weight).alias("value"),
    )
