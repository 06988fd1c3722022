"""Counts of overlaps by differences of ranks, without a row for any pair.

A tag overlaps the region [s, e) when it starts below e and does not end at or below s.  So
the number of such tags is a difference of two ranks: starts below e less ends at or below
s.  Both are running counts along the chromosome over tags' ends and regions' questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import strand_keys
from .overlap import overlap_join, stretched
from .scan import binned, running

#: Coordinates of one bin of depths, a power of two.
_DEPTH_BITS = 14

#: Order of what lies at one position: a question for starts below it, tags' starts and ends,
#: then questions for ends, of which an empty region does not see empty tags.
_BELOW, _TAG, _EMPTY_ASKS, _EMPTY_TAG, _UPTO = range(5)


def _spot(at: Column, turn: Column | int, **values: int) -> Column:
    turn = turn if isinstance(turn, Column) else F.lit(turn)
    return F.struct(at.alias("pos"), turn.cast("int").alias("turn"), *[F.lit(v).cast("long").alias(k) for k, v in values.items()])


def _plain_counts(tags: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    start, end = F.col("chromStart"), F.col("chromEnd")
    ends = F.when(start == end, _EMPTY_TAG).otherwise(_TAG)
    steps = tags.select(*keys, F.explode(F.array(_spot(start, _TAG, starts=1, ends=0), _spot(end, ends, starts=0, ends=1))).alias("s"))
    # Tags of one position are one row from here on, however many pile up.
    steps = steps.groupBy(*keys, F.col("s.pos").alias("pos"), F.col("s.turn").alias("turn")).agg(F.sum("s.starts").alias("starts"), F.sum("s.ends").alias("ends"))
    upto = F.when(start == end, _EMPTY_ASKS).otherwise(_UPTO)
    # One base needs one question: starts below s + 1 are those at or below s.
    asks = F.when(end == start + 1, F.array(_spot(start, _UPTO, rise=1, fall=1))).otherwise(F.array(_spot(end, _BELOW, rise=1, fall=0), _spot(start, upto, rise=0, fall=1)))
    asked = places.select(*keys, "chromStart", "chromEnd", F.explode(asks).alias("q")).select("*", "q.*").drop("q")
    merged = steps.unionByName(asked, allowMissingColumns=True)
    ranked = running(binned(merged, "pos"), keys, ["pos", "turn"], {"below": ("sum", F.col("starts")), "upto": ("sum", F.col("ends"))}).where("rise IS NOT NULL")
    part = F.col("rise") * F.col("below") - F.col("fall") * F.col("upto")
    return ranked.groupBy(*keys, "chromStart", "chromEnd").agg(F.sum(part).cast("long").alias("n"))


def overlap_counts(regions: DataFrame, tags: DataFrame, stranded: bool = False, ext5: int = 0, ext3: int = 0) -> DataFrame:
    """How many tags overlap each place: chromosome (and strand), ``chromStart``, ``chromEnd``, ``n``.

    Every place of ``regions`` has one row, those without tags n = 0.  Only tags of several
    blocks are joined with regions, since an intron may hold one.  Work grows with positions,
    not with depth: tags are counted by position before any window, and a window spans one
    bin of positions.  Null chromosomes and strands, and tags without an end, overlap nothing.
    """
    keys = strand_keys(stranded)
    wanted = [*keys, "chromStart", "chromEnd"]
    tags = stretched(tags, ext5, ext3).dropna(subset=wanted)
    places = regions.select(*wanted).distinct().dropna()
    if "blockSizes" not in tags.columns:
        return _plain_counts(tags.select(*wanted), places, keys)
    spliced = F.coalesce(F.size("blockSizes") > 1, F.lit(False))
    plain = _plain_counts(tags.where(~spliced).select(*wanted), places, keys)
    pairs = overlap_join(tags.where(spliced).select(*wanted, *([] if stranded else ["strand"] if "strand" in tags.columns else []), "blockSizes", "blockStarts"), places, stranded)
    more = pairs.groupBy(*[F.col(f"region_{c}").alias(c) for c in wanted]).agg(F.count(F.lit(1)).alias("n"))
    return plain.union(more.select(*wanted, "n")).groupBy(*wanted).agg(F.sum("n").alias("n"))


def base_depths(sites: DataFrame, tags: DataFrame, stranded: bool = False, column: str = "n") -> DataFrame:
    """Rows of one base each with ``column``, the tags over that base.

    Tags are steps, up at their start and down at their end, summed by position; one that
    reaches into further bins goes up once more at the head of each, so a bin needs nothing
    from those before it.  The rows go through the window with all their columns: they are
    neither made distinct nor joined back, and are computed once.
    """
    keys = strand_keys(stranded)
    s, e = F.col("chromStart"), F.col("chromEnd")
    first, last = F.shiftright(s, _DEPTH_BITS), F.shiftright(e - 1, _DEPTH_BITS)

    def step(b: Column, pos: Column, d: int) -> Column:
        return F.struct(b.alias("_bin"), pos.alias("_pos"), F.lit(d).cast("long").alias("_d"))

    slim = tags.dropna(subset=[*keys, "chromStart", "chromEnd"]).where(s < e).select(*keys, "chromStart", "chromEnd")
    # A branch of their own for the few tags that leave their bin: a lambda would be interpreted for every tag.
    heads = slim.where(first < last).select(*keys, F.explode(F.sequence(first + 1, last)).alias("_bin")).select(*keys, "_bin", F.shiftleft("_bin", _DEPTH_BITS).alias("_pos"), F.lit(1).cast("long").alias("_d"))
    ends = slim.select(*keys, F.explode(F.array(step(first, s, 1), step(last, e, -1))).alias("_s")).select(*keys, "_s._bin", "_s._pos", "_s._d")
    steps = ends.union(heads).groupBy(*keys, "_bin", "_pos").agg(F.sum("_d").alias("_d"))
    asked = sites.withColumn("_bin", first).withColumn("_pos", s).withColumn("_asks", F.lit(True))
    merged = asked.unionByName(steps, allowMissingColumns=True)
    # Rows of one position are peers, so those steps count whatever their order.  Sorts compare the
    # first eight bytes of a row at once: those of a bin tell rows apart, those of a chromosome hardly.
    upto = Window.partitionBy("_bin", *keys).orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return merged.withColumn(column, F.coalesce(F.sum("_d").over(upto), F.lit(0))).where("_asks").drop("_bin", "_pos", "_d", "_asks")


def region_numbers(regions: DataFrame, tags: DataFrame, stranded: bool = False, ext5: int = 0, ext3: int = 0) -> DataFrame:
    """Every region with ``n``, the tags that overlap it, by ranks instead of pairs."""
    counts = overlap_counts(regions, tags, stranded, ext5, ext3)
    place = [c for c in counts.columns if c != "n"]
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in place], F.col("n").alias("_n"))
    on = [regions[c] == counts[f"_{c}"] for c in place]
    return regions.join(counts, on, "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n", *[f"_{c}" for c in place])


def region_rpkm(regions: DataFrame, tags: DataFrame, **options) -> DataFrame:
    """Counts per kilobase of region and million tags, as ``rpkm``."""
    total = tags.agg(F.count(F.lit(1)).alias("_tags"))
    counted = region_numbers(regions, tags, **options).crossJoin(F.broadcast(total))  # one row
    size = F.col("chromEnd") - F.col("chromStart")
    return counted.withColumn("rpkm", F.coalesce(F.try_divide(F.col("n") * 1e9, F.col("_tags") * size), F.lit(0.0))).drop("_tags")
