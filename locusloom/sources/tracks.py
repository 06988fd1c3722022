"""bedGraph, wig and sgr tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bed import number_text


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """bedGraph segments with the strand that their track line names as ``(+)`` or ``(-)``.

    Track lines govern the lines below them in the same file.  Lines carry their byte
    order through the file's own row index, and only the few track lines are ranked: each
    segment finds its track among the ranges between them.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    tracks = lines.where(F.col("value").rlike("^track")).select("_file", "_at", F.regexp_extract("value", r"\(([+-])\)", 1).alias("strand"))
    below = Window.partitionBy("_file").orderBy("_at")  # a few track lines for each file
    tracks = tracks.select(F.col("_file").alias("_f"), F.col("_at").alias("_from"), F.lead("_at").over(below).alias("_to"), "strand")
    cells = F.split("value", r"\s+")
    body = lines.where(~F.col("value").rlike(r"^\s*$|^#|^track|^browser"))
    kinds = [("chrom", "string"), ("chromStart", "long"), ("chromEnd", "long"), ("score", "double")]
    parts = body.select("_file", "_at", *[F.get(cells, F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(kinds)])
    inside = (F.col("_file") == F.col("_f")) & (F.col("_at") > F.col("_from")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))
    named = parts.join(tracks, inside, "left")
    return named.select("chrom", "chromStart", "chromEnd", "score", F.when(F.col("strand") != "", F.col("strand")).alias("strand"))


def bedgraph_lines(coverage: DataFrame) -> DataFrame:
    return coverage.select(F.concat_ws("\t", "chrom", F.col("chromStart").cast("string"), F.col("chromEnd").cast("string"), number_text(F.col("score"))).alias("value"))


def write_bedgraph(coverage: DataFrame, path: str, name: str = "track", by_strand: bool = False, mode: str = "errorifexists") -> None:
    """Text of one track, or a folder for each strand.

    Every part file begins with the track line, so the parts can be joined in order.
    """
    for strand, suffix in (("+", ".pos"), ("-", ".neg")) if by_strand else ((None, ""),):
        own = coverage.where(F.col("strand") == strand) if strand else coverage
        label = f"{name} ({strand})" if strand else name
        head = coverage.sparkSession.createDataFrame([(f'track type=bedGraph name="{label}"',)], "value string")
        ordered = bedgraph_lines(own.repartitionByRange("chrom", "chromStart").sortWithinPartitions("chrom", "chromStart"))
        head.coalesce(1).unionByName(ordered).write.mode(mode).text(path + suffix)


def wig_lines(windows: DataFrame, width: int, step: int, value: str = "n") -> DataFrame:
    """fixedStep lines of each chromosome, one row of text for a chromosome's stretch.

    The start is the middle of the first window; a stretch has up to 10,000 windows.
    """
    stretch = F.floor(F.col("chromStart") / (step * 10_000))
    rows = F.sort_array(F.collect_list(F.struct("chromStart", number_text(F.col(value)).alias("v"))))  # one stretch
    text = windows.groupBy("chrom", stretch.alias("_s")).agg(rows.alias("r"))
    start = (F.element_at("r", 1)["chromStart"] + width // 2).cast("string")
    head = F.concat(F.lit("fixedStep chrom="), "chrom", F.lit(" start="), start, F.lit(f" step={step}"))
    return text.select(F.concat_ws("\n", head, F.array_join(F.transform("r", lambda r: r["v"]), "\n")).alias("value"))


def sgr_lines(windows: DataFrame, value: str = "n") -> DataFrame:
    """Chromosome, middle of the window, value."""
    middle = F.floor((F.col("chromStart") + F.col("chromEnd")) / 2)
    return windows.select(F.concat_ws("\t", "chrom", middle.cast("string"), number_text(F.col(value))).alias("value"))


def cluster_track_lines(clusters: DataFrame) -> DataFrame:
    """Cluster intervals and scores for a wiggle_0 track."""
    return clusters.select(F.concat_ws("\t", "chrom", F.col("chromStart").cast("string"), F.col("chromEnd").cast("string"), number_text(F.col("score"))).alias("value"))
