"""Record types, the coordinate convention and the attributes packed in names.

Coordinates are 0-based and half-open everywhere: an interval covers
``chromStart <= position < chromEnd``.  Attributes are columns; they are packed into
``name`` only on the way to a text file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BED6 = T.StructType(
    [
        T.StructField("chrom", T.StringType()),
        T.StructField("chromStart", T.LongType()),
        T.StructField("chromEnd", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("strand", T.StringType()),
    ]
)
BED12 = T.StructType(
    [
        *BED6.fields,
        T.StructField("thickStart", T.LongType()),
        T.StructField("thickEnd", T.LongType()),
        T.StructField("itemRgb", T.StringType()),
        T.StructField("blockCount", T.IntegerType()),
        T.StructField("blockSizes", T.ArrayType(T.LongType())),
        T.StructField("blockStarts", T.ArrayType(T.LongType())),
    ]
)
#: A mutation: the interval, its offset in the read, and what changed.
MUTATION = T.StructType(
    [
        T.StructField("chrom", T.StringType()),
        T.StructField("chromStart", T.LongType()),
        T.StructField("chromEnd", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("strand", T.StringType()),
        T.StructField("readOffset", T.LongType()),
        T.StructField("refBase", T.StringType()),
        T.StructField("mtype", T.StringType()),
        T.StructField("altBase", T.StringType()),
        T.StructField("matchStart", T.IntegerType()),
    ]
)


def length(prefix: str = "") -> Column:
    return F.col(f"{prefix}chromEnd") - F.col(f"{prefix}chromStart")


def forward() -> Column:
    return F.col("strand") == "+"


def five_prime() -> Column:
    """The first base of the read, as a position."""
    return F.when(forward(), F.col("chromStart")).otherwise(F.col("chromEnd") - 1)


def blocks(df: DataFrame) -> Column:
    """``array<struct<s, e>>`` of an interval's blocks; the interval itself if it has none."""
    whole = F.array(F.struct(F.col("chromStart").alias("s"), F.col("chromEnd").alias("e")))
    if "blockSizes" not in df.columns:
        return whole
    start = F.col("chromStart")
    cut = F.zip_with("blockStarts", "blockSizes", lambda at, size: F.struct((start + at).alias("s"), (start + at + size).alias("e")))
    return F.when(F.col("blockSizes").isNull() | (F.size("blockSizes") == 0), whole).otherwise(cut)


def default_name() -> Column:
    """``chrom:start-end`` with a 1-based start, where a name is missing."""
    made = F.concat("chrom", F.lit(":"), (F.col("chromStart") + 1).cast("string"), F.lit("-"), F.col("chromEnd").cast("string"))
    return F.coalesce(F.col("name"), made)


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill in what short BED lines lack: name, score 0, strand +."""
    for column, kind in (("name", "string"), ("score", "double"), ("strand", "string")):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast(kind))
    return df.withColumn("name", default_name()).withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("strand", F.coalesce("strand", F.lit("+")))


def copies_in_name(with_barcode: bool = False, signs: str = "[#-]") -> Column:
    """The copy number that stands last in a name, before the barcode if there is one."""
    return F.element_at(F.split("name", signs), -2 if with_barcode else -1).cast("double")


def barcode_in_name() -> Column:
    return F.element_at(F.split("name", "[#-]"), -1)


def packed(base: Column, **attributes: Column) -> Column:
    """``base[key=value]...`` for a text file."""
    return F.concat(base, *[F.concat(F.lit(f"[{k}="), v.cast("string"), F.lit("]")) for k, v in attributes.items()])


def unpacked(key: str, name: str = "name") -> Column:
    """The value of ``[key=value]`` in a name, null if it is not there."""
    found = F.regexp_extract(name, rf"\[{key}=([^\]]*)\]", 1)
    return F.when(found != "", found)


def strand_keys(stranded: bool) -> list[str]:
    return ["chrom", "strand"] if stranded else ["chrom"]
