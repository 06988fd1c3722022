"""Comparison of tag counts between two conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import binomial_p, phred


def differential(counts: DataFrame, key: str = "name", first: str = "n1", second: str = "n2", totals_from: DataFrame | None = None, expression: DataFrame | None = None, pseudo: float = 1e-7) -> DataFrame:
    """Exact binomial test of each row's two counts against the ratio of all counts.

    The ratio r = N1 / N2 comes from all rows, or those named in ``totals_from``; with
    ``expression`` (``key``, ``log2fc``) each row's r is multiplied by 2^log2fc.  p is
    computed once for each distinct pair of counts and ratio.  Returns ``p``, ``score``
    (-10 log10 p) and ``log2fc_counts`` = log2(n1 / n2 / r), with ``pseudo`` for zeros.
    """
    basis = counts.join(totals_from.select(key).distinct(), key, "left_semi") if totals_from is not None else counts
    totals = basis.agg(F.sum(first).alias("_N1"), F.sum(second).alias("_N2"))
    rows = counts.crossJoin(F.broadcast(totals))  # one row
    ratio = F.try_divide(F.col("_N1").cast("double"), F.col("_N2"))
    if expression is not None:
        rows = rows.join(expression.select(key, F.col("log2fc").alias("_e")), key, "left")
        ratio = ratio * F.pow(F.lit(2.0), F.coalesce("_e", F.lit(0.0)))
    rows = rows.withColumn("_r", ratio)
    hits = F.round(F.when(F.col(first) == 0, pseudo).otherwise(F.col(first))).cast("long")
    other = F.round(F.when(F.col(second) == 0, pseudo).otherwise(F.col(second))).cast("long")
    rows = rows.withColumn("_h", hits).withColumn("_t", hits + other)
    distinct = rows.select("_h", "_t", "_r").distinct()
    tested = distinct.withColumn("p", F.greatest(F.least(binomial_p(F.col("_h"), F.col("_t"), F.col("_r") / (F.col("_r") + 1)), F.lit(1.0)), F.lit(1e-100)))
    above = lambda c: F.when(F.col(c) == 0, pseudo).otherwise(F.col(c))
    tested = tested.select(F.col("_h").alias("_h2"), F.col("_t").alias("_t2"), F.col("_r").alias("_r2"), "p")
    out = rows.join(tested, (F.col("_h") == F.col("_h2")) & (F.col("_t") == F.col("_t2")) & F.col("_r").eqNullSafe(F.col("_r2")))
    return out.withColumn("score", F.round(phred(F.col("p")), 2)).withColumn("log2fc_counts", F.log2(above(first) / above(second) / F.col("_r"))).select(*counts.columns, "p", "score", "log2fc_counts")
