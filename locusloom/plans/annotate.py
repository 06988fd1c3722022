"""Annotation of intervals with genes, repeats, features and genomic regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import strand_keys
from ..operators.genes import first_gene
from ..operators.overlap import bin_width, overlap_join
from ..operators.tiles import tiled
from ..storage import saved

_NEED = ("chrom", "chromStart", "chromEnd", "strand", "blockSizes", "blockStarts")


def _pairs(intervals: DataFrame, features: DataFrame, rid: str, stranded: bool, extra: tuple[str, ...] = ("score",), **options) -> DataFrame:
    slim = intervals.select(rid, *[c for c in _NEED if c in intervals.columns])
    right = features.select(*[c for c in ("chrom", "chromStart", "chromEnd", "name", "strand", *extra) if c in features.columns])
    return overlap_join(slim, right, stranded, **options)


def annotate_gene(intervals: DataFrame, transcripts: DataFrame, transcript_gene: DataFrame, gene_symbol: DataFrame, rid: str = "name", stranded: bool = False) -> DataFrame:
    """``gene`` and ``symbol`` of each interval, null outside genes.

    An interval in several genes gets the smallest gene identifier.
    """
    hits = _pairs(intervals, transcripts, rid, stranded).select(rid, F.col("region_name").alias("transcript")).distinct()
    genes = hits.join(transcript_gene.select("transcript", "gene"), "transcript").select(rid, "gene").distinct()
    one = first_gene(genes, [rid], "gene").join(gene_symbol.select("gene", "symbol"), "gene", "left")
    return intervals.join(one, rid, "left")


def annotate_best(intervals: DataFrame, features: DataFrame, rid: str = "name", by: str = "overlap", largest: bool = True, stranded: bool = False, column: str = "feature") -> DataFrame:
    """The one feature that overlaps most (``by="overlap"``), or has the largest or least score.

    Ties go to the feature with the smaller start, then name.
    """
    value = F.col("fraction") if by == "overlap" else F.col("region_score")
    rank = Window.partitionBy(rid).orderBy(F.desc(value) if largest else F.asc(value), "region_chromStart", "region_name")
    best = _pairs(intervals, features, rid, stranded).withColumn("_nth", F.row_number().over(rank)).where("_nth = 1")
    return intervals.join(best.select(rid, F.col("region_name").alias(column)), rid, "left")


def annotate_all(intervals: DataFrame, features: DataFrame, rid: str = "name", stranded: bool = False, column: str = "feature", delimiter: str = "||") -> DataFrame:
    """The names of all overlapping features in order of start, joined by ``delimiter``."""
    hits = _pairs(intervals, features, rid, stranded)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("region_chromStart", "region_name"))), lambda r: r["region_name"]), delimiter)
    return intervals.join(hits.groupBy(rid).agg(names.alias(column)), rid, "left")


#: Region classes in the order in which labels are listed.
REGIONS = ("CDS", "5'UTR", "3'UTR", "exon_unclassified", "intron", "downstream_10k", "upstream_10k")
OUTSIDE = "deep_intergenic"


def _masked(intervals: DataFrame, segments: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Intervals of at most ``width`` bases with the ``_mask`` of the segments they meet.

    Such an interval lies in the bin of its start and the next one, so a bin holds the
    segments of both as one array, and an interval meets one row: it is shuffled once,
    by its place, and neither grouped nor joined back by its name.
    """
    s, e = F.col("chromStart"), F.col("chromEnd")
    bins = F.sequence(F.floor(s / width) - 1, F.floor((e - 1) / width))
    spread = segments.select(*keys, F.explode(bins).alias("_bin"), F.struct(s.alias("s"), e.alias("e"), "mask").alias("_t"))
    tiles = spread.groupBy(*keys, "_bin").agg(F.collect_list("_t").alias("_tiles"))
    met = F.aggregate("_tiles", F.lit(0).cast("long"), lambda m, t: F.when((s < t["e"]) & (t["s"] < e), m.bitwiseOR(t["mask"])).otherwise(m))
    return intervals.withColumn("_bin", F.floor(s / width)).join(tiles, [*keys, "_bin"], "left").select(*intervals.columns, met.alias("_mask"))


def _with_flags(intervals: DataFrame, sets: dict[str, DataFrame], rid: str, stranded: bool) -> DataFrame:
    """The intervals with a boolean column for each set that they overlap.

    The sets are tiled first (see :mod:`..operators.tiles`), so an interval meets few
    segments however many genes lie on one another, and what it meets is one number.
    Spliced and long intervals are joined by pairs, the others by the bin of their start.
    """
    segments = saved(tiled({kind: df.select("chrom", "chromStart", "chromEnd", "strand") for kind, df in sets.items()}, stranded))
    size = F.col("chromEnd") - F.col("chromStart")
    mean, longest = intervals.agg(F.avg(size), F.max(size)).first()
    width = bin_width(segments)[0]
    while width < 3 * (mean or 1.0):
        width *= 2
    short = F.coalesce(size <= width, F.lit(True))

    def paired(some: DataFrame) -> DataFrame:
        hits = _pairs(some, segments.withColumnRenamed("mask", "name"), rid, stranded, extra=())
        masks = hits.groupBy(F.col(rid).alias("_rid")).agg(F.bit_or("region_name").alias("_mask"))
        return some.join(masks, F.col(rid) == F.col("_rid"), "left").select(*[some[c] for c in some.columns], "_mask")

    if "blockSizes" in intervals.columns:
        out = paired(intervals)
    else:
        out = _masked(intervals.where(short), segments, strand_keys(stranded), width)
        if (longest or 0) > width:
            out = out.unionByName(paired(intervals.where(~short)))
    flags = [(F.coalesce("_mask", F.lit(0)).bitwiseAND(1 << i) != 0).alias(kind) for i, kind in enumerate(sets)]
    return out.select(*[c for c in intervals.columns if c not in sets], *flags)


def region_flags(intervals: DataFrame, sets: dict[str, DataFrame], rid: str = "name", stranded: bool = False) -> DataFrame:
    """Which of the interval sets ``genic exon 5utr 3utr cds upstream_10k downstream_10k`` each
    interval overlaps, as boolean columns."""
    return _with_flags(intervals, sets, rid, stranded).select(rid, *sets)


def _classes() -> dict[str, Column]:
    c = F.col
    return dict(
        zip(
            REGIONS,
            (c("cds"), c("5utr"), c("3utr"), c("exon") & ~(c("5utr") | c("3utr") | c("cds")), c("genic") & ~c("exon"), c("downstream_10k") & ~c("genic"), c("upstream_10k") & ~c("genic")),
            strict=True,
        )
    )


def annotate_region(intervals: DataFrame, sets: dict[str, DataFrame], rid: str = "name", stranded: bool = False, delimiter: str = "||") -> DataFrame:
    """Region labels of each interval, joined by ``delimiter``; ``deep_intergenic`` without any."""
    flags = _with_flags(intervals, sets, rid, stranded)
    labels = F.array_join(F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in _classes().items()])), delimiter)
    kept = [c for c in intervals.columns if c not in sets]
    return flags.select(*kept, F.when(labels == "", OUTSIDE).otherwise(labels).alias("region"))


def region_summary(intervals: DataFrame, sets: dict[str, DataFrame], rid: str = "name", stranded: bool = False) -> DataFrame:
    """Counts and percentages of intervals by region, and percentages adjusted to sum up.

    Adjusted: exonic intervals are shared out by the counts of coding and untranslated
    exons, intergenic ones near genes by those up- and downstream.  One pass of sums.
    """
    flags = region_flags(intervals, sets, rid, stranded)
    c = F.col
    kinds = {
        "Total": F.lit(True), "Genic": c("genic") | c("exon"), "Exon": c("exon"), "CDS exon": c("cds"), "5' UTR exon": c("5utr"), "3' UTR exon": c("3utr"),
        "Upstream 10K": c("upstream_10k") & ~c("genic"), "Downstream 10K": c("downstream_10k") & ~c("genic"), "Genic+ext10K": c("genic") | c("upstream_10k") | c("downstream_10k"),
    }
    sums = flags.agg(*[F.sum(F.coalesce(flag.cast("long"), F.lit(0))).alias(f"_{i}") for i, flag in enumerate(kinds.values())])
    n = {kind: F.coalesce(c(f"_{i}"), F.lit(0)) for i, kind in enumerate(kinds)}
    n["Intron"] = n["Genic"] - n["Exon"]
    n["Deep intergenic"] = n["Total"] - n["Genic+ext10K"]
    near = n["Genic+ext10K"] - n["Genic"]
    up = F.coalesce(F.floor(F.try_divide(n["Upstream 10K"].cast("double"), n["Upstream 10K"] + n["Downstream 10K"]) * near + 0.5), F.lit(0))
    named = n["5' UTR exon"] + n["3' UTR exon"] + n["CDS exon"]
    adjusted = {k: F.try_divide((n[k] * n["Exon"]).cast("double"), named) for k in ("CDS exon", "5' UTR exon", "3' UTR exon")}
    adjusted |= {"Upstream 10K": up.cast("double"), "Downstream 10K": (near - up).cast("double"), "Intron": n["Intron"].cast("double"), "Deep intergenic": n["Deep intergenic"].cast("double")}
    order = ("Total", "Genic", "Exon", "CDS exon", "5' UTR exon", "3' UTR exon", "Intron", "Upstream 10K", "Downstream 10K", "Genic+ext10K", "Deep intergenic")
    percent = lambda x: F.round(F.try_divide(x * 100.0, n["Total"]), 1)
    rows = [F.struct(F.lit(k).alias("region"), n[k].cast("long").alias("n"), percent(n[k]).alias("percent"), (percent(adjusted[k]) if k in adjusted else F.lit(None).cast("double")).alias("adjusted")) for k in order]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def annotate(intervals: DataFrame, analyses: dict[str, DataFrame], rid: str = "name") -> DataFrame:
    """Join the columns of several analyses to the intervals by row identifier."""
    out = intervals
    for df in analyses.values():
        new = [c for c in df.columns if c not in out.columns]
        out = out.join(df.select(rid, *new), rid, "left")
    return out


#: Headings of the text report.
_TITLE, _RULE = "Summary of {} annotation", "-" * 30
_COLUMNS, _ADJUSTED = ("Region", "No.", "%"), "Percentage of intervals in each region (adjusted):"
_ADJUSTED_ORDER = ("CDS exon", "5' UTR exon", "Upstream 10K", "3' UTR exon", "Downstream 10K", "Intron", "Deep intergenic")


def overlap_counts(annotated: DataFrame, column: str, label: str) -> DataFrame:
    """How many intervals a column annotates, and how many it does not: ``region n percent``."""
    sums = annotated.agg(F.count(F.lit(1)).alias("_all"), F.count(column).alias("_some"))
    rows = [F.struct(F.lit(text).alias("region"), n.alias("n"), F.coalesce(F.try_divide(n * 100.0, "_all"), F.lit(0.0)).alias("percent")) for text, n in ((label, F.col("_some")), ("Other", F.col("_all") - F.col("_some")))]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def report_section(analysis: str, counts: DataFrame) -> DataFrame:
    """The text section of one analysis, as ``nth`` and ``value``.

    ``counts`` is a table by :func:`overlap_counts` or :func:`region_summary`, a few rows;
    where it has adjusted percentages, a second table of them follows.
    """
    one = lambda c: F.format_string("%.1f", c)
    spark = counts.sparkSession
    head = [(0, ""), (1, ""), (2, _TITLE.format(analysis)), (3, _RULE), (4, ""), (5, "\t".join(_COLUMNS))]
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # a dozen rows
    body = counts.select((place + 5).cast("long").alias("nth"), F.concat_ws("\t", "region", F.col("n").cast("string"), one("percent")).alias("value"))
    out = spark.createDataFrame(head, "nth long, value string").union(body)
    if "adjusted" in counts.columns:
        more = [(100, ""), (101, _ADJUSTED), (102, "\t".join(("Region", "%")))]
        rank = F.array_position(F.array(*[F.lit(r) for r in _ADJUSTED_ORDER]), F.col("region"))
        shown = counts.where(rank > 0).select((rank + 102).cast("long").alias("nth"), F.concat_ws("\t", "region", one(F.coalesce("adjusted", F.lit(0.0)))).alias("value"))
        out = out.union(spark.createDataFrame(more, "nth long, value string")).union(shown)
    return out


def write_report(sections: list[DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Sections one after the other as one text file."""
    numbered = [s.select(F.lit(i).alias("_section"), "nth", "value") for i, s in enumerate(sections)]
    whole = reduce(DataFrame.unionByName, numbered).repartition(1).sortWithinPartitions("_section", "nth")  # a few dozen lines
    whole.select("value").write.mode(mode).text(path)
