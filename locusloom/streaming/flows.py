"""Streams of intervals and events.

Row-local operators (geometry, read filters, mutation selection, alignment parsing) take
streaming DataFrames as they are.  What needs state or a static side is here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.overlap import overlap_join


def overlap_with_static(stream: DataFrame, regions: DataFrame, stranded: bool = False, width: int = 4096) -> DataFrame:
    """Overlap pairs of a stream of tags with a static table of regions, without state."""
    return overlap_join(stream, regions, stranded, width=width)


def hopping_counts(events: DataFrame, time: str, width: str, step: str, late: str, keys: list[str], value: str | None = None) -> DataFrame:
    """Counts (and sums) of events by hopping window, late ones until the watermark passes."""
    total = [F.sum(value).alias("total")] if value else []
    windows = events.withWatermark(time, late).groupBy(F.window(time, width, step), *keys)
    return windows.agg(F.count(F.lit(1)).alias("n"), *total).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *(["total"] if value else []))


def first_copies(reads: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first read of each key; keys are forgotten once the watermark has passed them."""
    return reads.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
