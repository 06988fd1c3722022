"""Plain tables: mappings, chromosome lengths, lists, the dataset registry, reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = False) -> DataFrame:
    """Tab-separated text, all columns strings."""
    table = spark.read.csv(path, sep="\t", header=header, quote="", comment="#" if not header else None)
    return table.toDF(*columns) if columns else table


def write_tsv(df: DataFrame, path: str, header: bool = False, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=header, quote="", emptyValue="")


def read_mapping(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Two columns, as transcript to gene or gene to symbol."""
    return spark.read.csv(path, sep="\t", schema=f"`{key}` string, `{value}` string", quote="")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, length long")


def read_ids(spark: SparkSession, path: str, column: str = "name") -> DataFrame:
    """The first word of each line."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias(column)).where(F.col(column) != "")


def read_expression(spark: SparkSession, path: str, key: str = "name") -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=f"`{key}` string, log2fc double")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``genome analysis path [type]``; type is the analysis unless given, paths are
    relative to the registry's folder."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*($|#)"))
    cells = F.split(F.trim("value"), r"\s+")
    folder = os.path.dirname(path) or "."
    place = F.get(cells, F.lit(2))
    absolute = F.when(place.rlike(r"^(/|[a-z0-9]+://)"), place).otherwise(F.concat(F.lit(folder + "/"), place))
    return lines.select(F.get(cells, F.lit(0)).alias("genome"), F.get(cells, F.lit(1)).alias("analysis"), absolute.alias("path"), F.coalesce(F.get(cells, F.lit(3)), F.get(cells, F.lit(1))).alias("type"))


def locations(registry: DataFrame, genome: str, analysis: str) -> dict[str, str]:
    """Paths of one analysis by type; more than a thousand are an error, never cut."""
    rows = registry.where((F.col("genome") == genome) & (F.col("analysis") == analysis)).select("type", "path").limit(1001).collect()
    if not rows:
        raise KeyError(f"no {analysis} for {genome}")
    if len(rows) > 1000:
        raise ValueError(f"more than 1000 paths of {analysis} for {genome}")
    return {r["type"]: r["path"] for r in rows}


def report_lines(title: str, table: DataFrame) -> DataFrame:
    """A titled section of tab-separated lines with numbers to one decimal."""
    cells = [F.format_number(c, 1) if kind == "double" else F.col(c).cast("string") for c, kind in table.dtypes]
    body = table.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cells]).alias("value"))
    head = table.sparkSession.createDataFrame([(title,), ("\t".join(table.columns),)], "value string")
    return head.unionByName(body)
