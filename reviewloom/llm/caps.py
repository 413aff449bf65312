"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction put together from one code of each of four blocks of
coordinates (a random product code after a random rotation), so ``CODES ** 4``
directions need only ``4 * CODES`` inner products. Every vector is list-decoded:
it joins all filters whose inner product exceeds its threshold, ``margin`` below
its ``depth``-th best. Two vectors at an angle of 11 degrees (cosine 0.98) differ
in their inner product with a filter by about 0.02, so they share several of
their best filters. Pairs of one label that share a filter are compared in
double precision; measured against brute force, no pair is missed (README).

Equal vectors of one label are one node with a count. A pair is counted in the
smallest filter that both have, so sums over filters are exact; links leave a
task as counts and a spanning forest. Buckets over ``BLOCK_ROWS`` are cut into
cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import (
    checkpointed,
    close_pairs,
    components,
    forest,
    split_buckets,
    whole_groups,
)

BLOCKS = 4
CODES = 32
DEPTH = 4
MARGIN = 0.02
SEED = 20240229
BLOCK_ROWS = 1000
PAIR_CHUNK = 1 << 14
DENSE_ROWS = 32


def valid_vector(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero; never null."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_length(column: pa.Array) -> Iterator[np.ndarray]:
    """Row positions of each length of list."""
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def codebook(size: int) -> list[np.ndarray]:
    """For each block, codes x coordinates: unit codes, back in the original space.

    A block of few coordinates has few codes, so that no two are nearly the same.
    """
    rng = np.random.default_rng([SEED, size])
    rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
    out = []
    for part in np.array_split(np.arange(size), BLOCKS):
        width = len(part)
        if width < 2:
            drawn = np.ones((1, width)) if not width else np.array([[1.0], [-1.0]])
        elif width == 2:
            angles = np.arange(8) * np.pi / 4
            drawn = np.stack([np.cos(angles), np.sin(angles)], axis=1)
        else:
            drawn = rng.standard_normal((min(CODES, 4 << width - 1), width))
            drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
        out.append(drawn @ rotation[:, part].T / np.sqrt(BLOCKS))
    return out


def list_decode(scores: list[np.ndarray], depth: int, margin: float) -> np.ndarray:
    """Numbers of all filters within ``margin`` of the ``depth``-th best; scores: those of each block's codes."""
    first = (scores[0][:, None] + scores[1][None, :]).ravel()
    second = (scores[2][:, None] + scores[3][None, :]).ravel()
    # The depth best sums are made of the depth best of either half.
    best = np.add.outer(
        np.partition(first, -depth)[-depth:] if depth < len(first) else first,
        np.partition(second, -depth)[-depth:] if depth < len(second) else second,
    ).ravel()
    floor = np.sort(best)[-min(depth, len(best))] - margin
    near_first = np.flatnonzero(first >= floor - second.max())
    near_second = np.flatnonzero(second >= floor - first.max())
    i, j = np.nonzero(np.add.outer(first[near_first], second[near_second]) >= floor)
    return np.sort(near_first[i] * len(second) + near_second[j])


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the sorted list of filters to every (node, size, label, vector)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("vector")
        found: list = [None] * batch.num_rows
        for rows in by_length(column):
            vectors = vectors_of(column.take(pa.array(rows)))
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            scores = [vectors @ codes.T for codes in codebook(vectors.shape[1])]
            for place, row in enumerate(rows):
                found[row] = list_decode([score[place] for score in scores], DEPTH, MARGIN)
        yield batch.append_column("filters", pa.array(found, pa.list_(pa.int32())))


def _smallest_common(lists: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows, the smallest number in both of their sorted, padded lists."""
    out = np.empty(len(left), np.int64)
    for at in range(0, len(left), PAIR_CHUNK):
        a, b = lists[left[at : at + PAIR_CHUNK]], lists[right[at : at + PAIR_CHUNK]]
        shared = np.zeros(a.shape, bool)
        for k in range(b.shape[1]):
            shared |= a == b[:, k : k + 1]
        shared &= a >= 0
        out[at : at + PAIR_CHUNK] = a[np.arange(len(a)), shared.argmax(axis=1)]
    return out


def _cosines(vectors: np.ndarray, norms: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), PAIR_CHUNK):
        a, b = i[at : at + PAIR_CHUNK], j[at : at + PAIR_CHUNK]
        out[at : at + PAIR_CHUNK] = (vectors[a] * vectors[b]).sum(axis=1) / (norms[a] * norms[b])
    return out


def _dense_pairs(vectors, norms, lists, side, number, cosine) -> tuple[np.ndarray, np.ndarray]:
    """The links of one bucket, by products of whole matrices."""
    near = vectors / norms[:, None]
    gram = near @ near.T
    earlier, column = np.unique(np.where((lists >= 0) & (lists < number), lists, -1), return_inverse=True)
    held = np.zeros((len(lists), len(earlier)), np.float32)
    held[np.arange(len(lists))[:, None], column.reshape(lists.shape)] = 1
    held = held[:, (earlier >= 0) & (held.sum(axis=0) > 1)]
    found = np.triu(gram >= cosine - 1e-9, 1)
    found &= (side[:, None] == 0) | (side[:, None] != side[None, :])
    found &= held @ held.T == 0  # a pair with an earlier filter in common is counted there
    i, j = np.nonzero(found)
    sure = gram[i, j] > cosine + 1e-9
    sure[~sure] = _cosines(vectors, norms, i[~sure], j[~sure]) >= cosine
    return i[sure], j[sure]


def _links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Per node in a cell: vectors linked in this filter, and the node it hangs on."""
    for group in whole_groups(batches, "group"):
        group = group.combine_chunks()
        for rows in by_length(group.column("vector").combine_chunks()):
            part = group.take(pa.array(rows)).combine_chunks()
            node, size, number, side, keys = (
                part.column(c).to_numpy() for c in ("node", "size", "filter", "side", "group")
            )
            vectors = vectors_of(part.column("vector").combine_chunks())
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            decoded = part.column("filters").combine_chunks()
            lengths = np.diff(decoded.offsets.to_numpy())
            lists = np.full((len(node), int(lengths.max())), -1, np.int32)
            lists[np.arange(lists.shape[1]) < lengths[:, None]] = decoded.flatten().to_numpy()

            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            ends = np.append(starts[1:], len(keys))
            dense = ends - starts >= DENSE_ROWS
            pairs = []
            for low, high in zip(starts[dense], ends[dense]):
                own = slice(low, high)
                i, j = _dense_pairs(
                    vectors[own], norms[own], lists[own], side[own], number[low], cosine
                )
                pairs.append((i + low, j + low))
            rest = np.flatnonzero(np.repeat(~dense, ends - starts))

            def accept(i, j):
                i, j = rest[i], rest[j]
                kept = (number[i] == number[j]) & ((side[i] == 0) | (side[i] != side[j]))
                kept[kept] = _cosines(vectors, norms, i[kept], j[kept]) >= cosine
                kept[kept] = _smallest_common(lists, i[kept], j[kept]) == number[i[kept]]
                return kept

            i, j = close_pairs(keys[rest], accept)
            pairs.append((rest[i], rest[j]))
            left, right = (np.concatenate(side_) for side_ in zip(*pairs))
            linked = np.zeros(len(node), np.int64)
            np.add.at(linked, left, size[right])
            np.add.at(linked, right, size[left])
            root = forest(len(node), left, right, node)
            some = np.flatnonzero(linked)
            yield pa.record_batch(
                [pa.array(node[some]), pa.array(node[root[some]]), pa.array(linked[some])],
                names=["a", "b", "links"],
            )


def embedding_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows link when their labels are equal and not null, their vectors have equal
    length and at least the given cosine. A vector that is null, empty, zero or
    holds a null or non-finite component links with nothing and is a component of
    its own. Repeated rows link with each other and each get a result row. A row
    without id counts as a link of others but names no component and is not kept.
    An empty table gives an empty result.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).alias("vector"),
        F.col(label_col).alias("label"),
    ).withColumn("usable", valid_vector(F.col("vector")) & F.col("label").isNotNull())
    usable = rows.filter("usable")
    # A class without any id gets a negative number, apart from all others.
    classes = usable.groupBy("label", "vector").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("size")
    )
    nodes = checkpointed(
        classes.withColumn(
            "node",
            F.coalesce("least", -F.shiftrightunsigned(F.xxhash64("label", "vector"), 1) - 1),
        )
    )
    kind = vectors.schema[vector_col].dataType.simpleString()
    label_kind = vectors.schema[label_col].dataType.simpleString()
    decoded = nodes.select("node", "size", "label", "vector").mapInArrow(
        _filters, f"node long, size long, label {label_kind}, vector {kind}, filters array<int>"
    )
    keyed = decoded.withColumn("filter", F.explode("filters")).withColumn(
        "key", F.xxhash64("label", "filter")
    )
    cells = split_buckets(keyed, "key", "node", BLOCK_ROWS)
    found = checkpointed(
        cells.select(
            "node", "size", "filter", "vector", "filters", "side", F.xxhash64("label", "filter", "cell").alias("group")
        )
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInArrow(lambda batches: _links(batches, cosine), "a long, b long, links long")
    )
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    component = components(found.select("a", "b"))
    solved = (
        nodes.join(links, "node", "left")
        .join(component, "node", "left")
        .select(
            "label",
            "vector",
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = usable.join(solved, ["label", "vector"], "left").select(
        "vec_id", "n_links", F.when(F.col("component_id") >= 0, F.col("component_id")).alias("component_id")
    )
    alone = rows.filter("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
