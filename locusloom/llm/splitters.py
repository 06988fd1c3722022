"""Sampled splitters: quantile boundaries of a key, and the range of each record."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, uniform

#: Expected number of sampled keys for each range, and the most ranges of a job:
#: together they bound what reaches the driver to about a million short keys.
SAMPLES_PER_RANGE = 64
MOST_RANGES = 16_384


def range_count(spark: SparkSession, total_bytes: int, range_bytes: int) -> int:
    """Enough ranges for every task, none much above ``range_bytes``."""
    return max(1, min(MOST_RANGES, max(3 * shuffle_partitions(spark), -(-total_bytes // range_bytes))))


def weighted_sample(rows: DataFrame, weight: Column, total_weight: int, ranges: int, tie: Column) -> DataFrame:
    """Keep each row with a chance in proportion to its weight.

    ``tie`` is a 64-bit hash of the row; the draw depends on it alone, so reruns and
    retried tasks draw the same rows.  About ``SAMPLES_PER_RANGE * ranges`` stay.
    """
    rate = SAMPLES_PER_RANGE * ranges / max(1, total_weight)
    return rows.where(uniform(F.xxhash64(tie, F.lit("sample"))) < weight * F.lit(rate))


def quantiles(keys: Sequence, ranges: int) -> list:
    """Boundaries that cut the sorted sample into ``ranges`` equal parts, each once."""
    ordered = sorted(keys)
    cuts = [ordered[i * len(ordered) // ranges] for i in range(1, ranges)] if ordered else []
    return list(dict.fromkeys(cuts))


def range_of(key: Column, boundaries: list, element_type: str) -> Column:
    """How many boundaries are <= key, by binary search in a constant array.

    Only built-in functions: ``aggregate`` walks the powers of two downwards.
    """
    if not boundaries:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps(boundaries)), f"array<{element_type}>")
    step, steps = 1, []
    while step <= len(boundaries):
        steps.append(step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda at, s: F.when(F.get(array, at + s - 1) <= key, at + s).otherwise(at),
    )
