"""Connected components of a graph of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """The smallest node that each linked node can reach.

    ``links`` has two columns of one ordered type, in any order and with repeats.
    Alternating star rounds (Kiveris et al., 2014) need a number of rounds near the
    logarithm of the diameter.  Each round is joins and minima over the links; nothing
    is gathered, minima are combined before the shuffle, and a hub's links may be
    split between tasks.  Every round is written to the shared folder.

    Returns ``node`` and ``component`` for every node with a link.  Null nodes and
    links of a node to itself are left out; no links, no rows.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    pairs = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    mark = _mark(pairs)
    for _ in range(rounds):
        both = pairs.union(pairs.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(small.union(lowest).distinct())
        drop_saved(pairs)
        pairs, before, mark = after, mark, _mark(after)
        if mark == before:
            roots = pairs.select("v").distinct()
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _mark(pairs: DataFrame) -> tuple:
    """Number and sum of hashes of the links: equal marks, equal links."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
