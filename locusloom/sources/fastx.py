"""FASTA and FASTQ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _header(text):
    return F.regexp_extract(text, r"^[>@]?(\S*)", 1)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records that begin with ``>``; sequences may be broken over lines.

    The reader splits at the record mark itself, so records are found in parallel and need
    no numbering of lines.
    """
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)")
    return records.select(_header(head).alias("id"), F.regexp_replace(body, r"\s", "").alias("seq")).where("id != '' or seq != ''")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of four lines.

    A line's number in its file decides what it is.  Files are read in blocks; each
    block's lines are counted, the counts are summed along the file, and lines are numbered
    on from there, so one large file is read by many tasks.
    """
    place = F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    along = Window.partitionBy("f").orderBy("b")  # a few blocks for each file
    blocks = blocks.select("f", "b", "first", (F.sum("n").over(along) - F.col("n")).alias("before"))
    numbered = lines.join(blocks, ["f", "b"]).withColumn("n", F.col("before") + F.col("id") - F.col("first"))
    line = lambda i: F.max(F.when(F.col("n") % 4 == i, F.regexp_replace("value", "\r$", "")))
    records = numbered.groupBy("f", F.floor(F.col("n") / 4).alias("record")).agg(line(0).alias("head"), line(1).alias("seq"), line(3).alias("qual"))
    return records.where("qual is not null").select(_header(F.col("head")).alias("id"), "seq", "qual")


def fastx_lines(reads: DataFrame, as_fastq: bool | None = None) -> DataFrame:
    """Records as lines of text, FASTQ where there are qualities."""
    fastq = "qual" in reads.columns if as_fastq is None else as_fastq
    if fastq:
        return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), "qual").alias("value"))
    return reads.select(F.concat_ws("\n", F.concat(F.lit(">"), "id"), "seq").alias("value"))


def write_fastx(reads: DataFrame, path: str, as_fastq: bool | None = None, mode: str = "errorifexists") -> None:
    fastx_lines(reads, as_fastq).write.mode(mode).text(path)
