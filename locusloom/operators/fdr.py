"""False discovery rates of mutation sites from simulated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def site_histogram(sites: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Sites with k reads and m mutations, and how many have m or more at that k.

    Columns ``k``, ``m``, ``sites``, ``sites_ge`` (and ``extra`` keys).
    """
    keys = [*(extra or []), "k"]
    hist = sites.groupBy(*keys, "m").agg(F.count(F.lit(1)).alias("sites"))
    return hist.withColumn("sites_ge", F.sum("sites").over(Window.partitionBy(*keys).orderBy(F.desc("m"))))


def permutation_fdr(observed: DataFrame, simulated: DataFrame, iterations: int, smooth: bool = True) -> DataFrame:
    """q for every observed (k, m): the simulated sites with m or more at k over the observed.

    ``observed`` is a histogram by :func:`site_histogram`; so is ``simulated``, of one
    iteration or, with a key for it, of each.  All iterations are pooled before they are
    cumulated, since one that shows (k, m + 1) need not show (k, m).  A pair that no
    simulation shows exactly has q = 0.  With ``smooth`` q never falls as k grows at one m.
    """
    pooled = simulated.groupBy("k", "m").agg(F.sum("sites").alias("_sites"))
    drawn = pooled.select("k", "m", F.sum("_sites").over(Window.partitionBy("k").orderBy(F.desc("m"))).alias("_drawn"))
    q = F.when(F.col("_drawn").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("_drawn") / F.lit(float(iterations)) / F.col("sites_ge")))
    out = observed.join(drawn, ["k", "m"], "left").withColumn("fdr", q).drop("_drawn")
    if smooth:
        out = out.withColumn("fdr", F.max("fdr").over(Window.partitionBy("m").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return out
