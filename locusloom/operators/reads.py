"""Operators on sequence records: filters, barcodes, exact copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import not_acgt, qualities, quality_passes


def strip_barcode(reads: DataFrame, size: int = 5, starts_with: str = "", ends_with: str = "") -> DataFrame:
    """Move the first ``size`` bases to the end of the identifier, as ``id#BARCODE``.

    Reads no longer than the barcode drop out, and so do barcodes that lack the fixed
    ends, in either case of letters.
    """
    out = reads.where(F.length("seq") > size).withColumn("barcode", F.substring("seq", 1, size))
    if starts_with:
        out = out.where(F.upper("barcode").startswith(starts_with.upper()))
    if ends_with:
        out = out.where(F.upper("barcode").endswith(ends_with.upper()))
    out = out.withColumn("id", F.concat("id", F.lit("#"), "barcode")).withColumn("seq", F.expr(f"substring(seq, {size + 1})"))
    return out.withColumn("qual", F.expr(f"substring(qual, {size + 1})")) if "qual" in reads.columns else out


def filter_reads(reads: DataFrame, quality: str = "", index: str = "", max_n: int = -1, offset: int = 33) -> DataFrame:
    """Keep reads that meet all conditions.

    ``quality``: rules like ``mean:0-24:20``; ``index``: ``position:BASES`` from 0, in
    either case; ``max_n``: most characters other than ACGT, no limit if negative.
    """
    out = reads
    if index:
        at, bases = index.split(":")
        out = out.where(F.upper(F.substring("seq", int(at) + 1, len(bases))) == bases.upper())
    if quality:
        out = out.where(quality_passes(qualities(F.col("qual"), offset), quality))
    if max_n >= 0:
        out = out.where(not_acgt(F.col("seq")) <= max_n)
    return out


def collapse_fasta(reads: DataFrame) -> DataFrame:
    """One record for each sequence: the smallest identifier with ``#copies``."""
    found = reads.groupBy("seq").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    return found.select(F.concat("id", F.lit("#"), F.col("copies").cast("string")).alias("id"), "seq", "copies")


def collapse_fastq(reads: DataFrame) -> DataFrame:
    """The same with the quality line of the read whose identifier is smallest."""
    found = reads.groupBy("seq").agg(F.min(F.struct("id", "qual")).alias("first"), F.count(F.lit(1)).alias("copies"))
    return found.select(F.concat("first.id", F.lit("#"), F.col("copies").cast("string")).alias("id"), "seq", F.col("first.qual").alias("qual"), "copies")
