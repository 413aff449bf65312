"""Hard negatives by angular triangle filtering.

Vectors become whole numbers, ``floor(scale * x)``; a score is the inner product with
the anchor. Every row stores its norm and its angles to a few reference directions.
For an anchor a, a row v and a direction r the triangle inequality on the sphere gives

    |angle(a, r) - angle(v, r)| <= angle(a, v) <= angle(a, r) + angle(v, r)

(and at most a full turn less that sum), so all directions together give an interval
of the cosine, and times both norms one of the score, widened by more than rounding
can do. An anchor's best rows of its label are sought among those whose upper bound
reaches the best lower bounds; its negatives among the rows whose interval overlaps
one of the wanted windows of scores. Only those get their exact integer score.

The anchors are a stated query set, compared in blocks with all rows: a cell holds one
block of anchors and one part of the rows, both of bounded size, and gives a few rows
for each anchor. So neither a common vector nor a common label fills a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.caps import by_length, vectors_of
from reviewloom.llm.common import checkpointed, whole_groups

DIRECTIONS = 16
SAMPLE_ROWS = 512  # the directions are drawn from about so many rows; results do not depend on them
CELL_VALUES = 1 << 19  # components of the rows in a cell; those of its anchors are half as many
EXACT = float(1 << 53)
MOST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite; an empty vector is usable."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite, F.lit(False))


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``, as doubles, which hold it exactly."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * vectors)
    return np.clip(out, -np.finfo(float).max, np.finfo(float).max)


def spread_directions(vectors: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit rows, each the farthest in angle from those before it."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.linalg.norm(vectors, axis=1)
    units = vectors[(norms > 0) & np.isfinite(norms)]
    units = units / np.linalg.norm(units, axis=1, keepdims=True)
    chosen: list[int] = []
    nearest = np.full(len(units), -2.0)
    while len(chosen) < min(count, len(units)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:  # only copies are left
            break
        chosen.append(at)
        nearest = np.maximum(nearest, units @ units[at])
    return units[chosen]


def _angles(
    batches: Iterator[pa.RecordBatch], directions: dict[int, np.ndarray], scale: int
) -> Iterator[pa.RecordBatch]:
    """Add the norm of the whole-number vector and its angles to the directions."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("vector")
        norms = np.zeros(batch.num_rows)
        angles: list = [None] * batch.num_rows
        for rows in by_length(column):
            vectors = whole_numbers(vectors_of(column.take(pa.array(rows))), scale)
            with np.errstate(over="ignore", invalid="ignore"):
                norms[rows] = length = np.sqrt((vectors * vectors).sum(axis=1))
                known = directions.get(vectors.shape[1], np.empty((0, vectors.shape[1])))
                cosines = (vectors / np.where(length > 0, length, 1)[:, None]) @ known.T
            # A vector too long for its norm has no angles that say anything: see _bounds.
            found = np.arccos(np.clip(np.nan_to_num(cosines), -1, 1))
            for row, own in zip(rows, found):
                angles[row] = own
        yield batch.append_column("norm", pa.array(norms)).append_column(
            "angles", pa.array(angles, pa.list_(pa.float64()))
        )


def _bounds(norm, angles, norms, angle_rows, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of one anchor with each row."""
    with np.errstate(over="ignore", invalid="ignore"):
        reach = norm * norms
        least, most = np.zeros(len(norms)), np.full(len(norms), np.pi)
        for own, other in zip(angles, angle_rows.T):
            np.maximum(least, np.abs(own - other), out=least)
            np.minimum(most, np.minimum(own + other, 2 * np.pi - own - other), out=most)
        # An arc cosine near 1 is off by the root of the rounding error of the cosine.
        slack = reach * (1e-7 * np.sqrt(size + 1)) + 1
        low, high = reach * np.cos(most) - slack, reach * np.cos(least) + slack
    wild = ~np.isfinite(slack)
    return np.where(wild, -np.inf, low), np.where(wild, np.inf, high)


def _scores(anchor: np.ndarray, rows: np.ndarray, reach: float) -> np.ndarray:
    """Exact inner products of whole numbers; beyond 64 bits the nearest such number."""
    if reach < EXACT:  # then no partial sum of any order is rounded
        return (rows @ anchor).astype(np.int64)
    own = [int(x) for x in anchor]
    found = (sum(a * int(b) for a, b in zip(own, row)) for row in rows)
    return np.array([min(max(x, -MOST), MOST) for x in found], np.int64)


class _Cell:
    """The rows and the anchors of one length in one cell."""

    def __init__(self, part: pa.Table, scale: int):
        part = part.combine_chunks()
        self.label = part.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        self.id = part.column("vec_id").to_numpy()
        self.norm = part.column("norm").to_numpy()
        angles = part.column("angles").combine_chunks()
        self.angles = angles.flatten().to_numpy().reshape(len(part), -1)
        self.vector = whole_numbers(vectors_of(part.column("vector").combine_chunks()), scale)
        anchor = part.column("anchor").combine_chunks()
        is_anchor = anchor.is_valid().to_numpy(zero_copy_only=False)
        self.anchor = anchor.fill_null(-1).to_numpy()
        self.anchors = np.flatnonzero(is_anchor)
        rows = np.flatnonzero(~is_anchor)
        self.rows = rows[np.argsort(self.id[rows], kind="stable")]
        self.wanted = part.column("wanted").combine_chunks()

    def bounds(self, anchor: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _bounds(
            self.norm[anchor], self.angles[anchor], self.norm[rows], self.angles[rows], self.vector.shape[1]
        )

    def scores(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            reach = self.norm[anchor] * self.norm[rows].max(initial=0.0) * 1.001
        return _scores(self.vector[anchor], self.vector[rows], reach if reach == reach else np.inf)


def _positives(cell: _Cell, count: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, 0, ids, scores) of the ``count`` best rows of each anchor's label."""
    of_label = {x: cell.rows[cell.label[cell.rows] == x] for x in np.unique(cell.label[cell.anchors])}
    for anchor in cell.anchors:
        rows = of_label[cell.label[anchor]]
        rows = rows[cell.id[rows] != cell.id[anchor]]
        if len(rows) > count:
            low, high = cell.bounds(anchor, rows)
            rows = rows[high >= np.partition(low, -count)[-count]]
        scores = cell.scores(anchor, rows)
        best = np.argsort(-scores, kind="stable")[:count]  # rows are in order of their ids
        yield cell.anchor[anchor], 0, cell.id[rows[best]], scores[best]


def _windowed(
    cell: _Cell, count: int, low_share: int, high_share: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, wanted score, ids, scores) of the first ``count`` rows of other labels in each window."""
    for anchor in cell.anchors:
        windows = [
            (p, -(-low_share * p // 100), high_share * p // 100)
            for p in sorted(set(cell.wanted[anchor].as_py()))
        ]
        windows = [w for w in windows if w[1] <= w[2]]
        rows = cell.rows[cell.label[cell.rows] != cell.label[anchor]]
        low, high = cell.bounds(anchor, rows)
        overlap = np.zeros(len(rows), bool)
        for _, least, most in windows:
            overlap |= (high >= least) & (low <= most)
        rows = rows[overlap]
        scores = cell.scores(anchor, rows)
        order = np.argsort(-scores, kind="stable")
        falling = -scores[order]
        for wanted, least, most in windows:
            first = np.searchsorted(falling, max(-most, -MOST))
            last = np.searchsorted(falling, min(-least, MOST), "right")
            best = order[first : min(last, first + count)]
            yield cell.anchor[anchor], wanted, cell.id[rows[best]], scores[best]


def _searched(batches: Iterator[pa.RecordBatch], scale: int, search) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "cell"):
        table = table.combine_chunks()
        cells = table.column("cell").to_numpy()
        starts = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
        for low, high in zip(starts, np.append(starts[1:], len(cells))):
            part = table.slice(low, high - low).combine_chunks()
            for same in by_length(part.column("vector").combine_chunks()):
                found = list(search(_Cell(part.take(pa.array(same)), scale)))
                if not found:
                    continue
                sizes = [len(ids) for _, _, ids, _ in found]
                yield pa.record_batch(
                    [
                        pa.array(np.repeat([a for a, *_ in found], sizes).astype(np.int64)),
                        pa.array(np.repeat(np.array([w for _, w, *_ in found], np.int64), sizes)),
                        pa.array(np.concatenate([ids for *_, ids, _ in found])),
                        pa.array(np.concatenate([scores for *_, scores in found])),
                    ],
                    names=["anchor", "wanted", "vec_id", "score"],
                )


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def _directions(rows: DataFrame, total: int, scale: int) -> dict[int, np.ndarray]:
    """Reference directions for each length of vector in a bounded sample."""
    share = min(1 << 20, (SAMPLE_ROWS << 20) // max(total, 1) + 1)
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share)
    drawn = drawn.select("vector").limit(2 * SAMPLE_ROWS).toArrow().column("vector").combine_chunks()
    found = {}
    for same in by_length(drawn) if len(drawn) else ():
        vectors = whole_numbers(vectors_of(drawn.take(pa.array(same))), scale)
        found[vectors.shape[1]] = spread_directions(vectors, DIRECTIONS)
    return found


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str = "vec_id % 100 = 0",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low_share: int = 80,
    high_share: int = 100,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is SQL over ``vec_id``. An anchor's positives are the rows of its
    label, of other ids, with the highest scores; its negatives for a positive are the
    rows of other labels whose score is ``low_share`` to ``high_share`` per cent of the
    positive's, highest first. Ties go to the smaller id; there may be fewer than asked.

    Rows with a null id, label or vector, or with a null or non-finite component, take
    no part; a zero vector scores 0; vectors of different lengths are not compared.
    Repeated rows are one row; rows that share an id but not the rest are rows of their
    own, and an anchor with such a double gives the rows of both. Scores beyond 64 bits
    count as the nearest 64-bit number. An empty table gives an empty result.
    """
    rows = (
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(label_col).alias("label"),
            F.col(vector_col).alias("vector"),
        )
        .filter("vec_id is not null and label is not null")
        .filter(usable(F.col("vector")))
        .distinct()
    )
    kind = vectors.schema[vector_col].dataType.simpleString()
    label_kind = vectors.schema[label_col].dataType.simpleString()
    values = F.sum(F.size("vector") + 1)
    size = rows.agg(F.count("*").alias("rows"), values.alias("all"), F.sum(F.when(F.expr(is_anchor), F.size("vector") + 1)).alias("anchors")).first()
    parts = -(-(size["all"] or 1) // CELL_VALUES)
    blocks = -(-2 * (size["anchors"] or 1) // CELL_VALUES)
    directions = _directions(rows, size["rows"], scale)
    stored = "vec_id long, label {}, vector {}, norm double, angles array<double>"
    indexed = checkpointed(
        rows.mapInArrow(lambda b: _angles(b, directions, scale), stored.format(label_kind, kind))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("deal", F.xxhash64("vec_id", "vector"))
    )
    content = ["vec_id", "label", "vector", "norm", "angles"]

    def search(anchors: DataFrame, how) -> DataFrame:
        """What ``how`` finds in each cell, for anchors with ``wanted`` scores."""
        asked = anchors.select(
            *content,
            F.col("row").alias("anchor"),
            "wanted",
            F.pmod("deal", F.lit(blocks)).alias("block"),
            F.explode(_numbers(parts)).alias("part"),
        )
        compared = indexed.select(
            *content,
            F.lit(None).cast("long").alias("anchor"),
            F.lit(None).cast("array<long>").alias("wanted"),
            F.explode(_numbers(blocks)).alias("block"),
            F.pmod("deal", F.lit(parts)).alias("part"),
        )
        return (
            asked.unionByName(compared)
            .withColumn("cell", F.col("block") * parts + F.col("part"))
            .drop("block", "part")
            .repartition("cell")
            .sortWithinPartitions("cell")
            .mapInArrow(
                lambda batches: _searched(batches, scale, how),
                "anchor long, wanted long, vec_id long, score long",
            )
        )

    anchors = indexed.filter(is_anchor)
    no_score = F.lit(None).cast("array<long>")
    near = search(anchors.withColumn("wanted", no_score), lambda cell: _positives(cell, positives))
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    near = checkpointed(
        near.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= positives)
        .select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    wanted = near.groupBy("anchor").agg(F.collect_set("positive_score").alias("wanted"))
    found = search(
        anchors.join(wanted.withColumnRenamed("anchor", "row"), "row"),
        lambda cell: _windowed(cell, negatives, low_share, high_share),
    )
    first = Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        near.withColumn("wanted", F.col("positive_score"))
        .join(found, ["anchor", "wanted"])
        .join(named, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
