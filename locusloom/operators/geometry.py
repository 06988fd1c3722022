"""Row-local changes of intervals: extend, flank, clamp, cut, colour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draw import drawn_below
from ..model import forward


def _moved(df: DataFrame, plus: tuple, minus: tuple) -> DataFrame:
    start = F.when(forward(), plus[0]).otherwise(minus[0])
    end = F.when(forward(), plus[1]).otherwise(minus[1])
    both = df.withColumn("_s", start).withColumn("_e", end)
    return both.withColumn("chromStart", F.col("_s")).withColumn("chromEnd", F.col("_e")).drop("_s", "_e")


def extend(df: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """Add ``left`` to the 5' end and ``right`` to the 3' end, counted along the read.

    A negative ``left`` reaches upstream and a positive ``right`` downstream; the other
    signs shorten the interval.  What has no base left drops out.
    """
    s, e = F.col("chromStart"), F.col("chromEnd")
    return _moved(df, (s + left, e + right), (s - right, e - left)).where("chromEnd > chromStart")


def grow(df: DataFrame, left: int = 0, right: int = 0) -> DataFrame:
    """Move the 5' end outwards by ``left`` and the 3' end by ``right``."""
    return extend(df, -left, right)


def flank_down(df: DataFrame, left: int, right: int) -> DataFrame:
    """The stretch from ``left`` to ``right`` bases after the 3' end (0: its last base)."""
    if right < left:
        raise ValueError("right must not be below left")
    s, e = F.col("chromStart"), F.col("chromEnd")
    return _moved(df, (e - 1 + left, e + right), (s - right, s - left + 1))


def flank_up(df: DataFrame, left: int, right: int) -> DataFrame:
    """The stretch from ``left`` to ``right`` bases at the 5' end; -1, -1 is the base before it."""
    if right < left:
        raise ValueError("right must not be below left")
    s, e = F.col("chromStart"), F.col("chromEnd")
    return _moved(df, (s + left, s + right + 1), (e - 1 - right, e - left))


def random_subinterval(df: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """``size`` bases at a place drawn evenly inside each interval, the same on every run.

    Intervals shorter than ``size`` stay as they are.
    """
    length = F.col("chromEnd") - F.col("chromStart")
    draw = drawn_below(F.greatest(length - size, F.lit(1)), seed, *(F.col(c) for c in ("chrom", "chromStart", "chromEnd", "name")))
    start = F.when(length > size, F.col("chromStart") + draw).otherwise(F.col("chromStart"))
    return df.withColumn("_s", start).withColumn("chromEnd", F.when(length > size, F.col("_s") + size).otherwise(F.col("chromEnd"))).withColumn("chromStart", F.col("_s")).drop("_s")


def clamp(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """Cut intervals to ``[0, length)`` of their chromosome; one beyond it becomes its last base.

    Chromosomes that ``lengths`` does not know are only cut at 0.  Its rows, one for each
    chromosome, are broadcast: a shuffle by chromosome would leave as few tasks as those.
    """
    known = df.join(F.broadcast(lengths.select("chrom", F.col("length").alias("_len"))), "chrom", "left")
    top = F.coalesce(F.col("_len"), F.col("chromEnd"))
    start = F.greatest(F.least(F.greatest("chromStart", F.lit(0)), top - 1), F.lit(0))
    end = F.greatest(F.least(F.greatest("chromEnd", F.lit(1)), top), start + 1)
    out = known.withColumn("_s", start).withColumn("_e", end)
    return out.withColumn("chromStart", F.col("_s")).withColumn("chromEnd", F.col("_e")).select(*df.columns)


#: The named colours and their red, green and blue parts.
COLOURS = {
    "red": "255,0,0",
    "darkred": "139,0,0",
    "green": "0,255,0",
    "darkgreen": "0,100,0",
    "lightgreen": "144,238,144",
    "blue": "0,0,255",
    "darkblue": "0,0,139",
    "lightblue": "173,216,230",
    "skyblue": "135,206,235",
    "pink": "255,192,203",
    "purple": "160,32,240",
    "brown": "165,42,42",
    "cyan": "0,255,255",
    "yellow": "255,255,0",
}


def coloured(df: DataFrame, colour: str = "blue") -> DataFrame:
    """Add ``itemRgb`` (a name above or ``r,g,b``) and thick columns over the whole interval."""
    rgb = COLOURS.get(colour, colour)
    if not all(p.isdigit() and int(p) < 256 for p in rgb.split(",")) or rgb.count(",") != 2:
        raise ValueError(f"unknown colour {colour!r}")
    for column, source in (("thickStart", "chromStart"), ("thickEnd", "chromEnd")):
        df = df.withColumn(column, F.coalesce(column, source) if column in df.columns else F.col(source))
    return df.withColumn("itemRgb", F.lit(rgb))
