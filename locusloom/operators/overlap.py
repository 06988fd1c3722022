"""Joins of intervals by overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import blocks, forward, strand_keys

#: Regions of more than this many bins are joined on bins as many times wider.
WIDE = 64


def bin_width(regions: DataFrame) -> tuple[int, bool]:
    """A power of two near three times the mean length of the regions, and whether some
    region fills more than ``WIDE`` such bins."""
    size = F.col("chromEnd") - F.col("chromStart")
    mean, longest = regions.agg(F.avg(size), F.max(size)).first()
    width = 64
    while width < 3 * (mean or 1.0):
        width *= 2
    return width, (longest or 0) > width * WIDE


def stretched(df: DataFrame, ext5: int, ext3: int) -> DataFrame:
    """Move both ends outwards along the read; the outer blocks of a spliced one follow."""
    if not ext5 and not ext3:
        return df
    left, right = F.when(forward(), ext5).otherwise(ext3), F.when(forward(), ext3).otherwise(ext5)
    out = df
    if "blockSizes" in df.columns:
        n = F.size("blockSizes")
        sizes = F.transform("blockSizes", lambda size, i: size + F.when(i == 0, left).otherwise(0) + F.when(i == n - 1, right).otherwise(0))
        starts = F.transform("blockStarts", lambda at, i: F.when(i == 0, at).otherwise(at + left))
        out = out.withColumn("_sizes", sizes).withColumn("_starts", starts)
        out = out.withColumn("blockSizes", F.col("_sizes")).withColumn("blockStarts", F.col("_starts")).drop("_sizes", "_starts")
    return out.withColumn("_left", left).withColumn("chromEnd", F.col("chromEnd") + right).withColumn("chromStart", F.col("chromStart") - F.col("_left")).drop("_left")


def _in_intron(start: Column, end: Column) -> Column:
    """Whether the region lies between two blocks of the tag."""
    gaps = F.zip_with(F.slice("_blocks", 1, F.greatest(F.size("_blocks") - 1, F.lit(0))), F.slice("_blocks", 2, F.size("_blocks")), lambda a, b: F.struct(a["e"].alias("s"), b["s"].alias("e")))
    return F.exists(gaps, lambda gap: (gap["s"] <= start) & (end <= gap["e"]))


def overlap_join(
    tags: DataFrame,
    regions: DataFrame,
    stranded: bool = False,
    ext5: int = 0,
    ext3: int = 0,
    denominator: str = "tag",
    complete: bool = False,
    first_only: bool = False,
    width: int | None = None,
) -> DataFrame:
    """Every pair of a tag and a region that share a base.

    Spark has no interval join: an equality on the chromosome alone would compare all
    pairs of a chromosome.  Both sides are therefore spread over bins of coordinates
    and joined on the bin; a pair is kept only in the bin of the later of its two starts,
    so it comes once, without a distinct.  Regions that fill more than ``WIDE`` bins
    use bins ``WIDE`` times as wide, so a few long genes do not multiply rows.

    Returns the tag's columns, the region's as ``region_...``, ``overlap`` (bases) and
    ``fraction`` of the tag (``denominator="tag"``) or the region.  Spliced tags count
    their blocks, and one whose intron holds the region does not overlap it.
    ``complete`` keeps fractions of 1; ``first_only`` the first such region of each tag
    by start.
    """
    tags = stretched(tags, ext5, ext3)
    width, some_wide = (width, True) if width else bin_width(regions)
    wide = width * WIDE
    keys = strand_keys(stranded)
    spliced = "blockSizes" in tags.columns

    def bins(start: str, end: str, w: int) -> Column:
        return F.sequence(F.floor(F.col(start) / w), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / w))

    right = regions.select(*[F.col(c).alias(f"region_{c}") for c in regions.columns])
    long = (F.col("region_chromEnd") - F.col("region_chromStart")) > wide
    right = right.withColumn("_wide", long).withColumn("_bin", F.explode(F.when(long, bins("region_chromStart", "region_chromEnd", wide)).otherwise(bins("region_chromStart", "region_chromEnd", width))))
    spots = F.transform(bins("chromStart", "chromEnd", width), lambda b: F.struct(F.lit(False).alias("wide"), b.alias("bin")))
    if some_wide:
        spots = F.concat(spots, F.transform(bins("chromStart", "chromEnd", wide), lambda b: F.struct(F.lit(True).alias("wide"), b.alias("bin"))))
    left = tags.withColumn("_spot", F.explode(spots))
    on = [left[k] == right[f"region_{k}"] for k in keys] + [left["_spot"]["wide"] == right["_wide"], left["_spot"]["bin"] == right["_bin"]]
    meets = (F.col("chromStart") < F.col("region_chromEnd")) & (F.col("region_chromStart") < F.col("chromEnd"))
    home = F.floor(F.greatest("chromStart", "region_chromStart") / F.when(F.col("_wide"), wide).otherwise(width)) == F.col("_bin")
    pairs = left.join(right, on).where(meets & home).drop("_spot", "_wide", "_bin")
    if spliced:
        pairs = pairs.withColumn("_blocks", blocks(tags)).where(~_in_intron(F.col("region_chromStart"), F.col("region_chromEnd")))
        shared = F.aggregate(
            "_blocks", F.lit(0).cast("long"),
            lambda n, b: n + F.greatest(F.least(b["e"], F.col("region_chromEnd")) - F.greatest(b["s"], F.col("region_chromStart")), F.lit(0)),
        )
        size = F.aggregate("_blocks", F.lit(0).cast("long"), lambda n, b: n + b["e"] - b["s"])
    else:
        shared = F.least("chromEnd", "region_chromEnd") - F.greatest("chromStart", "region_chromStart")
        size = F.col("chromEnd") - F.col("chromStart")
    if denominator == "region":
        size = F.col("region_chromEnd") - F.col("region_chromStart")
    elif denominator != "tag":
        raise ValueError(f"unknown denominator {denominator!r}")
    pairs = pairs.withColumn("overlap", shared).withColumn("fraction", F.col("overlap") / size).drop("_blocks")
    if complete:
        pairs = pairs.where(F.col("fraction") >= 1 - 1e-10)
    if first_only:
        order = [F.col(f"region_{c}") for c in ("chromStart", "chromEnd", "name") if c in regions.columns]
        first = Window.partitionBy(*_plain(tags)).orderBy(*order)
        pairs = pairs.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return pairs


def _plain(df: DataFrame) -> list[str]:
    """The columns that tell rows apart."""
    return [c for c, kind in df.dtypes if not kind.startswith("map")]


def overlap_filter(tags: DataFrame, regions: DataFrame, keep: bool = True, key: list[str] | None = None, **options) -> DataFrame:
    """Tags that overlap some region (``keep``), or none.

    Rows are told apart by ``key``, all columns unless given; rows that are equal in it
    share their fate.  Chromosomes without regions have no overlaps.
    """
    key = key or _plain(tags)
    columns = [c for c in ("chrom", "chromStart", "chromEnd", "strand", "blockSizes", "blockStarts") if c in tags.columns]
    need = tags.select(*dict.fromkeys([*key, *columns]))
    slim = regions.select(*[c for c in ("chrom", "chromStart", "chromEnd", "strand") if c in regions.columns])
    # The pair carries extended coordinates, so the key goes along under its own name.
    own = need.select(F.struct(*key).alias("_key"), *columns)
    hits = overlap_join(own, slim, **options).select("_key").distinct()
    same = F.struct(*[tags[c] for c in key]).eqNullSafe(hits["_key"])
    return tags.join(hits, same, "left_semi" if keep else "left_anti")


def region_counts(regions: DataFrame, tags: DataFrame, region_key: list[str] | None = None, **options) -> DataFrame:
    """For every region, the tags that overlap it: ``n``, ``total`` and ``mean`` score.

    Regions without tags have n = 0, total = 0 and mean = 0.  A tag counts once for a
    region however many of its blocks lie in it.  Where only n is wanted,
    :func:`~.ranks.region_numbers` makes no pairs.
    """
    key = region_key or ["chrom", "chromStart", "chromEnd", "name", "strand"]
    pairs = overlap_join(tags, regions.select(*key), **options)
    score = F.col("score") if "score" in tags.columns else F.lit(1.0)
    sums = pairs.groupBy(*[F.col(f"region_{k}").alias(f"_{k}") for k in key]).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("total"))
    on = [regions[k].eqNullSafe(sums[f"_{k}"]) for k in key]
    out = regions.join(sums, on, "left").drop(*[f"_{k}" for k in key])
    out = out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0.0)))
    return out.withColumn("mean", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)))


def region_peaks(regions: DataFrame, signal: DataFrame, stranded: bool = False, no_match: float = -1e10, region_key: list[str] | None = None) -> DataFrame:
    """The highest signal segment inside each region, and its extent at half height.

    Segments that tie widen the peak.  The half-height extent runs from the first to the
    last segment above half of the peak.  Without any segment the score is ``no_match``
    and positions are null.
    """
    key = region_key or ["chrom", "chromStart", "chromEnd", "name", "strand"]
    rk = [f"region_{k}" for k in key]
    pairs = overlap_join(signal.select("chrom", "chromStart", "chromEnd", *(["strand"] if stranded else []), "score"), regions.select(*key), stranded)
    pairs = pairs.withColumn("peakScore", F.max("score").over(Window.partitionBy(*rk)))
    top, half = F.col("score") == F.col("peakScore"), F.col("score") > F.col("peakScore") / 2
    found = pairs.groupBy(*[F.col(r).alias(f"_{k}") for r, k in zip(rk, key, strict=True)]).agg(
        F.max("peakScore").alias("peakScore"),
        F.min(F.when(top, F.col("chromStart"))).alias("peakStart"), F.max(F.when(top, F.col("chromEnd"))).alias("peakEnd"),
        F.min(F.when(half, F.col("chromStart"))).alias("halfPeakStart"), F.max(F.when(half, F.col("chromEnd"))).alias("halfPeakEnd"),
    )
    on = [regions[k].eqNullSafe(found[f"_{k}"]) for k in key]
    return regions.join(found, on, "left").drop(*[f"_{k}" for k in key]).withColumn("peakScore", F.coalesce("peakScore", F.lit(no_match)))
