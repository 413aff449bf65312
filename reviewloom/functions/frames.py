"""Putting small result frames together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_by_key(keys: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Columns of frames with at most one row per group, side by side.

    A union and one aggregation instead of a join: null keys match, groups
    missing from a frame get nulls, and no side has to fit anywhere. Without
    keys it puts one-row frames next to each other.
    """
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    values = [c for c in merged.columns if c not in keys]
    return merged.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])
