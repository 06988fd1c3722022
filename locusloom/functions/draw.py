"""Random numbers from MD5, the same on every run and in every engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 60


def drawn(seed: object, *parts: Column) -> Column:
    """A number below 2^60 from a seed and the row's parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def drawn_below(count: Column, seed: object, *parts: Column) -> Column:
    """A whole number from 0 to ``count - 1``, evenly."""
    return F.least(F.floor(drawn(seed, *parts) / F.lit(float(1 << _BITS)) * count), count - 1)
