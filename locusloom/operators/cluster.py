"""Clusters of neighbouring intervals (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import barcode_in_name, strand_keys
from ..storage import saved
from .scan import binned, running, with_previous


def _identity(df: DataFrame) -> list[str]:
    """A declared order for rows that start alike."""
    return [c for c in ("chromStart", "chromEnd", "name", "score") if c in df.columns]


def islands(df: DataFrame, keys: list[str], max_gap: int = 0, strict: bool = False) -> DataFrame:
    """Add ``island``: the start of the island that a row belongs to.

    A row joins the island before it if the gap from the furthest end so far to its
    start is at most ``max_gap`` (``strict``: below it).  A negative gap asks for an
    overlap.  Together with ``keys``, ``island`` names one island.
    """
    order = _identity(df)
    seen = running(binned(df), keys, order, {"_reach": ("max", F.col("chromEnd"))}, inclusive=False)
    gap = F.col("chromStart") - F.col("_reach")
    near = gap < max_gap if strict else gap <= max_gap
    first = F.when(~F.coalesce(near, F.lit(False)), F.struct("chromStart", *[c for c in order if c != "chromStart"]))
    # Starts ascend, so the last first row is the largest; equal starts may part under a negative gap.
    out = running(seen.withColumn("_first", first), keys, order, {"_head": ("max", F.col("_first"))})
    return out.withColumn("island", F.col("_head")).drop("_bin", "_reach", "_first", "_head")


def _numbered(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``name``: ``chr_f_cN``, ``chr_r_cN`` or ``chr_cN``, numbered from 0 along the chromosome."""
    order = ["chromStart", "chromEnd", *[c for c in ("island", "_group") if c in clusters.columns]]
    counted = running(binned(clusters), keys, order, {"_nth": ("sum", F.lit(1))}).drop("_bin")
    side = F.when(F.col("strand") == "+", "_f_c").otherwise("_r_c") if "strand" in keys else F.lit("_c")
    return counted.withColumn("name", F.concat("chrom", side, (F.col("_nth") - 1).cast("string"))).drop("_nth")


def cluster(df: DataFrame, max_gap: int = 0, stranded: bool = False, weight: Column | None = None) -> DataFrame:
    """One interval for each island; score = rows, or the sum of ``weight``."""
    keys = strand_keys(stranded)
    score = F.sum("_weight") if weight is not None else F.count(F.lit(1))
    # Rows alike in both ends lie in one island, unless they are shorter than the overlap asked for: only those need telling apart.
    short = F.col("chromEnd") - F.col("chromStart") < -max_gap
    told = [F.when(short, F.col(c)).alias(c) for c in ("name", "score") if c in df.columns and max_gap < 0]
    slim = df.select(*keys, "chromStart", "chromEnd", *told, *([] if weight is None else [weight.alias("_weight")]))
    found = islands(slim, keys, max_gap).groupBy(*keys, "island").agg(
        F.min("chromStart").alias("chromStart"), F.max("chromEnd").alias("chromEnd"), score.cast("double").alias("score"), F.count(F.lit(1)).alias("n")
    )
    # Numbering looks at the clusters twice; they are written once, not made twice.
    found = _numbered(saved(found), keys).withColumn("strand", F.col("strand") if stranded else F.lit("+"))
    return found.select("chrom", "chromStart", "chromEnd", "name", "score", "strand", "n")


def site_counts(sites: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sites at one position and strand as one, with ``m`` the number of them.

    The same as islands with a gap of minus the site's size, but by grouping alone.
    """
    keys = keys or ["chrom", "chromStart", "chromEnd", "strand"]
    return sites.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))


def collapse_intervals(df: DataFrame, mode: int, stranded: bool = False, weight: Column | None = None, keep_score: bool = False, by_barcode: bool = False) -> DataFrame:
    """Collapse intervals that match at both ends (mode 1) or lie in another (mode 2).

    The longest row of a group represents it, with the number of rows (or the sum of
    ``weight``) as score unless ``keep_score``.  ``by_barcode`` collapses within each
    barcode, the last part of the name; names without a barcode of ACGT drop out.
    Ties go to the smallest name.
    """
    keys = strand_keys(stranded)
    if by_barcode:
        df = df.withColumn("_barcode", F.upper(barcode_in_name())).where(F.col("_barcode").rlike("^[ACGT]+$"))
        keys = [*keys, "_barcode"]
    if mode == 1:
        grouped, group = df, [*keys, "chromStart", "chromEnd"]
    elif mode == 2:
        order = ["chromStart", F.desc("chromEnd"), "name"]
        marked = running(binned(df), keys, order, {"_reach": ("max", F.col("chromEnd"))}, inclusive=False)
        marked = marked.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("chromEnd") > F.col("_reach")), 1).otherwise(0))
        grouped, group = running(marked, keys, order, {"_group": ("sum", F.col("_new"))}), [*keys, "_group"]
    else:
        raise ValueError("mode is 1 or 2")
    score = F.sum(weight) if weight is not None else F.count(F.lit(1))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col("chromEnd") - F.col("chromStart")), "name")
    out = grouped.withColumn("_nth", F.row_number().over(best)).withColumn("_sum", score.over(Window.partitionBy(*group)).cast("double")).where("_nth = 1")
    return out.withColumn("score", F.col("score") if keep_score else F.col("_sum")).select(*[c for c in df.columns if c != "_barcode"])


def overlap_clusters(df: DataFrame, fraction: float, stranded: bool = False) -> DataFrame:
    """Islands whose members overlap the row before them by ``fraction`` of the shorter."""
    keys, order = strand_keys(stranded), _identity(df)
    seen = with_previous(binned(df), keys, order, "_before")
    size, before = F.col("chromEnd") - F.col("chromStart"), F.col("_before.chromEnd") - F.col("_before.chromStart")
    enough = F.col("_before.chromEnd") - F.col("chromStart") >= fraction * F.least(size, before)
    marked = seen.withColumn("_new", F.when(F.coalesce(enough, F.lit(False)), 0).otherwise(1))
    marked = running(marked, keys, order, {"_group": ("sum", F.col("_new"))})
    found = marked.groupBy(*keys, "_group").agg(F.min("chromStart").alias("chromStart"), F.max("chromEnd").alias("chromEnd"), F.count(F.lit(1)).cast("double").alias("score"))
    return _numbered(found, keys).drop("_group")


#: Order in which the rows of a group are preferred.
_CRITERIA = {
    "maxScore": lambda: F.desc("score"),
    "minScore": lambda: F.asc("score"),
    "maxLen": lambda: F.desc(F.col("chromEnd") - F.col("chromStart")),
    "minLen": lambda: F.asc(F.col("chromEnd") - F.col("chromStart")),
    "random": lambda: F.asc(F.xxhash64("name", "chromStart")),
    "singleton": lambda: F.asc("name"),
}


def best_per_island(df: DataFrame, criterion: str = "maxScore", max_gap: int = 0, same_strand: bool = False, same_name: bool = False, same_interval: bool = False) -> DataFrame:
    """One row of every island, or of every set of equal intervals.

    Rows group if the gap is below ``max_gap``.  ``singleton`` keeps only islands of one
    row.  Ties go to the smaller start, then name.
    """
    if max_gap < 0:
        raise ValueError("max_gap must not be negative")
    keys = strand_keys(same_strand) + (["name"] if same_name else [])
    if same_interval:
        grouped, group = df, [*keys, "chromStart", "chromEnd"]
    else:
        grouped, group = islands(df, keys, max_gap, strict=True), [*keys, "island"]
    rank = Window.partitionBy(*group).orderBy(_CRITERIA[criterion](), "chromStart", "name")
    out = grouped.withColumn("_nth", F.row_number().over(rank))
    if criterion == "singleton":
        out = out.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*group))).where("_size = 1")
    return out.where("_nth = 1").select(*df.columns)
