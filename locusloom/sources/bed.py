"""BED files, with 3 to 12 columns, and what is written from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BED12, with_defaults


def _numbers(text: Column) -> Column:
    """``1,2,3,`` as an array."""
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: x.cast("long"))


def read_bed(spark: SparkSession, path: str | list[str], defaults: bool = False) -> DataFrame:
    """BED lines of any width, missing trailing columns null.

    Track lines, comments and blank lines are skipped.  Compressed files and whole
    directories work as everywhere in Spark.  ``defaults`` fills in name, score, strand.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$|^#|^track\b|^browser\b"))
    cells = F.split("value", "\t")
    out = []
    for i, field in enumerate(BED12.fields):
        text = F.get(cells, F.lit(i))
        text = F.when(F.trim(text) != "", text)
        value = _numbers(text) if field.dataType.typeName() == "array" else text.cast(field.dataType)
        out.append(value.alias(field.name))
    table = lines.select(*out)
    return with_defaults(table) if defaults else table


def read_bed6(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_bed(spark, path, defaults=True).select("chrom", "chromStart", "chromEnd", "name", "score", "strand")


def read_bed_by_chromosome(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of ``<chromosome>.bed`` files, with the file's chromosome as ``file_chrom``."""
    lines = spark.read.text(f"{folder}/*.bed").select("value", F.regexp_extract("_metadata.file_name", r"^(.*)\.bed$", 1).alias("file_chrom"))
    cells = F.split("value", "\t")
    names = ["chrom", "chromStart", "chromEnd", "name", "score", "strand"]
    kinds = ["string", "long", "long", "string", "double", "string"]
    good = lines.where(~F.col("value").rlike(r"^\s*$|^#|^track\b"))
    return with_defaults(good.select(*[F.get(cells, F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))], "file_chrom"))


def number_text(value: Column, digits: int = 2) -> Column:
    """A number without needless zeros, at most ``digits`` after the point."""
    rounded = F.round(value, digits)
    return F.when(rounded == F.floor(rounded), rounded.cast("long").cast("string")).otherwise(rounded.cast("string"))


def bed_lines(df: DataFrame) -> DataFrame:
    """Tab-separated lines of as many BED columns as the table has."""
    cells = []
    for field in BED12.fields:
        if field.name not in df.columns:
            break
        if field.name == "score":
            cells.append(number_text(F.col("score")))
        elif field.dataType.typeName() == "array":
            cells.append(F.concat(F.array_join(F.col(field.name).cast("array<string>"), ","), F.lit(",")))
        else:
            cells.append(F.col(field.name).cast("string"))
    return df.select(F.concat_ws("\t", *[F.coalesce(c, F.lit(".")) for c in cells]).alias("value"))


def write_bed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    bed_lines(df).write.mode(mode).text(path)


def mutation_lines(mutations: DataFrame) -> DataFrame:
    """The eleven columns of a mutation."""
    columns = ["chrom", "chromStart", "chromEnd", "name", "offset", "strand", "readOffset", "refBase", "mtype", "altBase", "matchStart"]
    return mutations.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value"))


def write_mutations(mutations: DataFrame, path: str, mode: str = "errorifexists") -> None:
    mutation_lines(mutations).write.mode(mode).text(path)
