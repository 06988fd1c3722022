"""Several interval sets as one tiling: disjoint segments, each with a mask of the sets that cover it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import strand_keys
from ..storage import saved
from .scan import binned, running

#: Sets are bits of a 64-bit number, the sign left out.
MOST_SETS = 63


def tiled(sets: dict[str, DataFrame], stranded: bool = False) -> DataFrame:
    """Segments ``chrom chromStart chromEnd mask`` (and ``strand``): bit i is set where set i covers.

    A sweep: ends of all sets are counted by position and set, the counts run along the
    chromosome in bins (see :mod:`.scan`), and a segment lasts as long as its mask.  However
    many intervals of one set lie on one another, a place is in one segment.  Empty intervals
    cover nothing.
    """
    if len(sets) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets")
    keys = strand_keys(stranded)

    def steps(i: int, df: DataFrame) -> DataFrame:
        ends = F.array(F.struct(F.col("chromStart").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("chromEnd").alias("pos"), F.lit(-1).alias("d")))
        return df.dropna(subset=[*keys, "chromStart", "chromEnd"]).select(*keys, F.explode(ends).alias("_e"), F.lit(i).alias("set")).select(*keys, "_e.*", "set")

    every = reduce(DataFrame.unionByName, [steps(i, df) for i, df in enumerate(sets.values())])
    # Three steps below read it; positions are few beside intervals.
    counted = saved(every.groupBy(*keys, "pos").agg(*[F.sum(F.when(F.col("set") == i, F.col("d")).otherwise(0)).alias(f"d{i}") for i in range(len(sets))]))
    placed = binned(counted, "pos")
    summed = running(placed, keys, ["pos"], {f"n{i}": ("sum", F.col(f"d{i}")) for i in range(len(sets))})
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"n{i}") > 0, F.lit(1 << i)).otherwise(0).cast("long") for i in range(len(sets))])
    # Rows at which nothing changes end no segment; each bin keeps its first.
    inside = Window.partitionBy(*keys, "_bin").orderBy("pos")
    changes = summed.select(*keys, "_bin", "pos", mask.alias("mask")).withColumn("_was", F.lag("mask").over(inside)).where("_was IS NULL OR _was != mask")
    along = Window.partitionBy(*keys).orderBy("_bin")
    heads = placed.groupBy(*keys, "_bin").agg(F.min("pos").alias("_head")).select(*keys, "_bin", F.lead("_head").over(along).alias("_next"))
    out = changes.join(heads, [*keys, "_bin"]).withColumn("chromEnd", F.coalesce(F.lead("pos").over(inside), F.col("_next")))
    return out.where("mask != 0").select(*keys, F.col("pos").alias("chromStart"), "chromEnd", "mask")
