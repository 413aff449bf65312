"""What several operators share: tables, Arrow batches, buckets and links.

Operators take a frame and the names of its id and value columns, select those
two under names of their own and ignore every other column, so extra columns
cannot clash with anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.sources.files import checkpointed, scan_parquet, shared_folder

# A table of keys is broadcast only after its rows were counted.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet", columns or None)


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: compressed, and read again in parts."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores before those that are taken."""
    taken = {name.lower() for name in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small_side(df: DataFrame) -> DataFrame:
    """A checkpointed frame, with a broadcast hint only if it was counted to be small."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and their n+1 offsets; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the integer column ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def close_pairs(keys: np.ndarray, accept) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of equal sorted ``keys`` that ``accept(i, j)`` keeps, i < j.

    Goes through the distances j - i, so memory follows the rows, not the pairs.
    """
    n = len(keys)
    ends = np.searchsorted(keys, keys, "right")
    left, right = [], []
    at = np.flatnonzero(ends - np.arange(n) > 1)
    step = 1
    while len(at):
        kept = accept(at, at + step)
        left.append(at[kept])
        right.append(at[kept] + step)
        step += 1
        at = at[ends[at] - at > step]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n rows, the position of the smallest id it hangs together with."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = rank.copy()
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, order[label[left]], low)
        np.minimum.at(new, order[label[right]], low)
        new = new[order][new]  # a root's own label, so chains halve
        if np.array_equal(new, label):
            break
        label = new
    return order[label]


def split_buckets(rows: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Add ``cell`` and ``side``: a bucket over ``limit`` rows becomes pairs of its blocks.

    The blocks are dealt by the hash of ``member``. A cell holds two blocks (or
    one with itself), so every pair of the bucket meets in some cell, no cell
    exceeds about twice ``limit`` rows, and no task gets a whole hot bucket.
    Within a cell of two blocks only rows of different ``side`` need comparing.
    """
    hot = checkpointed(
        rows.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > limit)
        .select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_blocks"))
    )
    found = hot.count()
    if not found:
        return rows.withColumns({"cell": F.lit(0).cast("long"), "side": F.lit(0)})
    if found <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    block = F.pmod(F.xxhash64(member), F.coalesce("_blocks", F.lit(1))).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1),
        lambda other: F.struct(
            (
                F.least(other, F.col("_block")).cast("long") * F.lit(1 << 20)
                + F.greatest(other, F.col("_block"))
            ).alias("cell"),
            # 0: alone in its cell; else 1 or 2
            F.when(other == F.col("_block"), 0)
            .when(F.col("_block") < other, 1)
            .otherwise(2)
            .alias("side"),
        ),
    )
    return (
        rows.join(hot, key, "left")
        .withColumn("_block", block)
        .withColumn("_cell", F.explode(cells))
        .select(*rows.columns, "_cell.cell", "_cell.side")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b) of longs.

    Returns (node, component) for every node but the smallest of its component;
    ``component`` is that smallest node. Rounds of large-star and small-star:
    every step is a grouping with map-side minima and an equi-join, so a hub is
    neither gathered nor expanded to pairs; each round is checkpointed.
    """
    now = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        now = checkpointed(
            joined.filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least)
            .distinct()
        )
