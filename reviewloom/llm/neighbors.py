"""Approximate nearest neighbours along shifted Hilbert curves.

Every vector is projected at random to ``DIMS`` dimensions, once per curve, the
box is shifted by a random offset and the Hilbert key of the cell is taken. Along
each curve the rows are range-partitioned into ``BLOCKS`` windows at quantiles of
the key. A query is sent to its own window and ``REACH`` windows on either side,
on every curve; what these windows find is merged and reranked by the exact
cosine in double precision.

Windows are shares of the rows, the same at every size, not numbers of rows: vectors
without structure have neighbours barely nearer than the rest, and a window of fixed
size would lose them as the table grows. A query is scored against five windows of 30
on each of twelve curves (recall and cost in the README). Only a table of fewer rows
than 30 answers has fewer windows, so that a window can hold an answer. Nothing is
fitted: projections and shifts follow from the length of the vectors alone.

Equal vectors are one candidate that keeps its smallest ids, as many as an answer
can use, so a common vector neither fills a window nor travels often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.caps import by_length, valid_vector, vectors_of
from reviewloom.llm.common import checkpointed, small_side, whole_groups

CURVES = 12
DIMS = 8
DEPTH = 7  # bits per dimension; DIMS * DEPTH must fit a long
BLOCKS = 30
REACH = 2
SEED = 20240229
TASK_ROWS = 4096  # a window of more rows is searched by several tasks
# Twice this many standard deviations of a projected unit vector span the box.
SPREAD = 3.6
SLACK = 1e-9


def hilbert_keys(cells: np.ndarray, depth: int) -> np.ndarray:
    """Position on the Hilbert curve of rows of coordinates below ``2 ** depth``.

    The transform of Skilling (2004), for all rows at once.
    """
    axes = [column.astype(np.uint64) for column in cells.T]
    one = np.uint64(1)
    for level in range(depth - 1, 0, -1):
        bit = one << np.uint64(level)
        below = bit - one
        for axis, values in enumerate(axes):
            inverted = (values & bit) != 0
            swap = np.where(inverted, np.uint64(0), (axes[0] ^ values) & below)
            axes[0] = axes[0] ^ swap ^ np.where(inverted, below, np.uint64(0))
            if axis:
                axes[axis] = values ^ swap
    for axis in range(1, len(axes)):
        axes[axis] = axes[axis] ^ axes[axis - 1]
    flip = np.zeros(len(cells), np.uint64)
    for level in range(depth - 1, 0, -1):
        bit = one << np.uint64(level)
        flip ^= np.where((axes[-1] & bit) != 0, bit - one, np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for level in range(depth - 1, -1, -1):
        for values in axes:
            key = key << one | (values ^ flip) >> np.uint64(level) & one
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Rows x curves: the key of each vector on each shifted curve."""
    size = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng([SEED, size])
    half = SPREAD / np.sqrt(size)
    keys = np.empty((len(vectors), CURVES), np.int64)
    for curve in range(CURVES):
        axes = rng.standard_normal((size, min(DIMS, size)))
        axes = np.linalg.qr(axes)[0]
        shift = rng.uniform(-half / 8, half / 8, axes.shape[1])
        cells = (unit @ axes + shift + half) / (2 * half) * (1 << DEPTH)
        keys[:, curve] = hilbert_keys(
            np.clip(cells, 0, (1 << DEPTH) - 1).astype(np.int64), DEPTH
        )
    return keys


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("vector")
        found: list = [None] * batch.num_rows
        for rows in by_length(column):
            for row, keys in zip(rows, curve_keys(vectors_of(column.take(pa.array(rows))))):
                found[row] = keys
        yield batch.append_column("keys", pa.array(found, pa.list_(pa.int64())))


def _nearest(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The ``top`` nearest rows of each query within each window."""
    for table in whole_groups(batches, "window"):
        table = table.combine_chunks()
        windows = table.column("window").to_numpy()
        starts = np.flatnonzero(np.diff(windows, prepend=windows[0] - 1))
        for low, high in zip(starts, np.append(starts[1:], len(windows))):
            part = table.slice(low, high - low).combine_chunks()
            query = part.column("query").combine_chunks()
            asks = np.flatnonzero(query.is_valid().to_numpy(zero_copy_only=False))
            rows = np.flatnonzero(query.is_null().to_numpy(zero_copy_only=False))
            if not len(asks) or not len(rows):
                continue
            vectors = vectors_of(part.column("vector").combine_chunks())
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            unit = vectors / norms[:, None]
            ids = part.column("ids").combine_chunks().take(pa.array(rows))
            counts, ids = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
            first = np.cumsum(counts) - counts
            out = []
            for at in range(0, len(asks), 256):
                some = asks[at : at + 256]
                scores = unit[some] @ unit[rows].T
                k = min(top, len(rows))
                floor = np.partition(scores, -k, axis=1)[:, -k] - SLACK
                i, j = np.nonzero(scores >= floor[:, None])
                a, b = some[i], rows[j]
                exact = (vectors[a] * vectors[b]).sum(axis=1) / (norms[a] * norms[b])
                # One line for each id of an equal vector.
                line = np.repeat(np.arange(len(i)), counts[j])
                step = np.arange(len(line)) - np.repeat(np.cumsum(counts[j]) - counts[j], counts[j])
                found = ids[first[j[line]] + step]
                order = np.lexsort((found, -exact[line], i[line]))
                owner = i[line][order]
                place = np.arange(len(order)) - np.searchsorted(owner, owner)
                best = order[place < top]
                out.append((query.take(pa.array(a[line[best]])), found[best], exact[line[best]]))
            yield pa.record_batch(
                [
                    pa.concat_arrays([x[0] for x in out]),
                    pa.array(np.concatenate([x[1] for x in out])),
                    pa.array(np.concatenate([x[2] for x in out])),
                ],
                names=["query", "vec_id", "score"],
            )


def nearest_neighbors(
    vectors: DataFrame,
    is_query: str = "vec_id % 50 = 0",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    top: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows found nearest to each query.

    ``is_query`` is SQL over ``vec_id``. Ties go to the smaller id. A row is no
    candidate for a query of its own id. Rows without id, and vectors that are
    null, empty, zero or hold a null or non-finite component, take no part;
    vectors of different lengths are not compared. A repeated row is one
    candidate and one query. An empty table gives an empty result.
    """
    rows = (
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")
        )
        .filter("vec_id is not null")
        .filter(valid_vector(F.col("vector")))
    )
    kind = vectors.schema[vector_col].dataType.simpleString()
    keep = top + 1  # the query itself may be among them
    # Spark cuts such a rank before the shuffle, so a common vector is not gathered.
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    candidates = (
        rows.withColumn("place", F.dense_rank().over(by_id))
        .filter(F.col("place") <= keep)
        .groupBy("vector")
        .agg(F.collect_set("vec_id").alias("ids"))
        .select("vector", "ids", F.lit(None).cast("long").alias("query"))
    )
    asked = rows.filter(is_query)
    queries = (
        asked.groupBy("vector")
        .agg(F.min("vec_id").alias("query"))
        .select("vector", F.lit(None).cast("array<long>").alias("ids"), "query")
    )
    keyed = checkpointed(
        candidates.union(queries)
        .mapInArrow(_keyed, f"vector {kind}, ids array<long>, query long, keys array<long>")
        .withColumn("length", F.size("vector"))
    )
    spread = F.posexplode("keys").alias("curve", "key")
    shares = [i / BLOCKS for i in range(1, BLOCKS)]
    bounds = small_side(
        keyed.filter("query is null")
        .select("length", spread)
        .groupBy("length", "curve")
        .agg(
            F.percentile_approx("key", shares).alias("bounds"),
            F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.count("*") / keep))).alias(
                "blocks"
            ),
            F.count("*").alias("rows"),
        )
        .withColumn("parts", F.ceil(F.col("rows") / F.col("blocks") / TASK_ROWS))
    )
    below = F.size(F.filter("bounds", lambda bound: bound <= F.col("key")))
    block = F.floor(below * F.col("blocks") / BLOCKS)
    placed = keyed.select("length", "vector", "ids", "query", spread).join(bounds, ["length", "curve"])
    placed = placed.withColumn("block", block)
    reached = F.when(
        F.col("query").isNull(),
        F.array(F.struct(F.col("block"), F.pmod(F.xxhash64("vector"), F.col("parts")).alias("part"))),
    ).otherwise(
        F.flatten(
            F.transform(
                F.sequence(
                    F.greatest(F.lit(0), F.col("block") - REACH),
                    F.least(F.col("blocks") - 1, F.col("block") + REACH),
                ),
                lambda b: F.transform(
                    F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
                    lambda p: F.struct(b.alias("block"), p.alias("part")),
                ),
            )
        )
    )
    found = (
        placed.withColumn("at", F.explode(reached))
        .select(
            F.xxhash64("length", "curve", "at.block", "at.part").alias("window"), "vector", "ids", "query"
        )
        .repartition("window")
        .sortWithinPartitions("window")
        .mapInArrow(lambda batches: _nearest(batches, keep), "query long, vec_id long, score double")
    )
    merged = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    merged = merged.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= keep)
    answers = asked.distinct().join(queries.select("vector", "query"), "vector").select(
        F.col("vec_id").alias("query_id"), "query"
    )
    own = Window.partitionBy("query_id", "query").orderBy("place")
    return (
        answers.join(merged, "query")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
