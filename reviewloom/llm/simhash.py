"""Near-duplicate documents by SimHash, with pigeonring filtering.

A fingerprint of 64 bits has a bit set where more than half of the document's
shingle hashes have it. Two fingerprints link at up to ``budget`` differing
bits. The bits are cut into ``budget + 1`` segments on a ring; two linked
fingerprints have a segment from which every chain of consecutive segments keeps
within its proportional share of the budget: l segments differ in at most
``l * budget / segments`` bits. So the first segment is equal and the second
differs in at most one bit, hence one of its halves is equal too. Equal
(segment, half of the next segment) are the join key; longer chains prune what a
key brings together, and only then all bits are compared.

Equal fingerprints are one node, so copies meet no join. In a bucket, links are
reduced to a spanning forest before they leave the task; large buckets are cut
into cells. Components of the remaining links are found by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import (
    checkpointed,
    close_pairs,
    components,
    forest,
    split_buckets,
    whole_groups,
)

BITS = 64
SEED = 42
BLOCK_ROWS = 2000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the whole text, A-Z lower-cased; 0 without words."""
    # bytes.split() cuts at exactly space and the bytes 9 to 13.
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        hashes = np.fromiter((digest(s, SEED) for s in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * votes > len(shingles))
    return int.from_bytes(packed.tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter(
            (fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows
        )
        yield pa.record_batch(
            [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "bits"]
        )


def segments(budget: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment on the ring."""
    edges = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def _field(bits, low: int, width: int):
    return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << width) - 1))


def ring_keys(budget: int) -> list:
    """A struct (start, key) for each start on the ring and half of the next segment."""
    ring, keys = segments(budget), []
    for start, (low, width) in enumerate(ring):
        next_low, next_width = ring[(start + 1) % len(ring)]
        halves = [(next_low, next_width // 2), (next_low + next_width // 2, next_width - next_width // 2)]
        for half, (half_low, half_width) in enumerate(halves):
            number = F.lit(start * 2 + half).cast("long")
            value = F.shiftleft(_field(F.col("bits"), low, width), half_width).bitwiseOR(
                _field(F.col("bits"), half_low, half_width)
            )
            keys.append(
                F.struct(F.lit(start).alias("start"), F.xxhash64(number, value).alias("key"))
            )
    return keys


def _links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    ring = segments(budget)
    masks = np.array([((1 << width) - 1) << low for low, width in ring], np.uint64)
    for group in whole_groups(batches, "group"):
        column = {c: group.column(c).to_numpy() for c in group.column_names}
        bits, start, side = column["bits"].view(np.uint64), column["start"], column["side"]

        def accept(i, j):
            keep = (side[i] == 0) | (side[i] != side[j])
            keep &= start[i] == start[j]
            differ = bits[i] ^ bits[j]
            total = np.zeros(len(i), np.int64)
            for length in range(1, len(ring) + 1):
                mask = masks[(start[i] + length - 1) % len(ring)]
                total += np.bitwise_count(differ & mask)
                keep &= total <= length * budget // len(ring)
            return keep & (np.bitwise_count(differ) <= budget)

        left, right = close_pairs(column["group"], accept)
        root = forest(len(bits), left, right, column["node"])
        moved = np.flatnonzero(column["node"][root] != column["node"])
        yield pa.record_batch(
            [pa.array(column["node"][moved]), pa.array(column["node"][root[moved]])],
            names=["a", "b"],
        )


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, width: int = 4
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    A null or empty text has fingerprint zero and links like any other. A row
    without id gets the component of its fingerprint but names none; a component
    of such rows only is null. A repeated row gives a repeated result row. An
    empty table gives an empty result.
    """
    prints = checkpointed(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(
            lambda batches: _fingerprints(batches, width), "doc_id long, bits long"
        )
    )
    nodes = prints.groupBy("bits").agg(F.min("doc_id").alias("node")).filter("node is not null")
    keyed = nodes.select("node", "bits", F.explode(F.array(*ring_keys(budget))).alias("k")).select(
        "node", "bits", "k.start", "k.key"
    )
    cells = split_buckets(keyed, "key", "node", BLOCK_ROWS)
    grouped = cells.select("node", "bits", "start", "side", F.xxhash64("key", "cell").alias("group"))
    edges = (
        grouped.repartition("group")
        .sortWithinPartitions("group")
        .mapInArrow(lambda batches: _links(batches, budget), "a long, b long")
    )
    found = components(edges)
    labels = nodes.join(found, "node", "left").select(
        "bits", F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(labels, "bits", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
