"""Running sums and maxima along a chromosome in two levels.

A window over a whole chromosome would leave a job with as many tasks as there are
chromosomes.  Rows are cut into bins of coordinates: each bin is reduced to one number,
the few numbers are scanned along the chromosome, and each bin then runs on its own
from what the bins before it leave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 17


def binned(df: DataFrame, position: str = "chromStart", width: int = BIN) -> DataFrame:
    return df.withColumn("_bin", F.floor(F.col(position) / width))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Add running columns to rows that :func:`binned` has marked.

    ``values``: new column -> ("sum" or "max", what to run over).  ``order`` must be
    consistent with the bins.  Not inclusive: rows before the present one only, null at
    the first for a maximum and 0 for a sum.
    """
    how = {"sum": F.sum, "max": F.max}
    place = ["_bin", *keys]
    along = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    # Sorts compare the first eight bytes of a row at once: those of a bin tell rows apart, those of a chromosome hardly.
    inside = Window.partitionBy("_bin", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    sums = df.groupBy(*place).agg(*[how[kind](value).alias(f"_{name}") for name, (kind, value) in values.items()])
    sums = sums.select(*place, *[how[kind](f"_{name}").over(along).alias(f"_{name}") for name, (kind, _) in values.items()])
    out = df.join(sums, place)
    for name, (kind, value) in values.items():
        own = how[kind](value).over(inside)
        if kind == "sum":
            out = out.withColumn(name, F.coalesce(f"_{name}", F.lit(0)) + F.coalesce(own, F.lit(0)))
        else:
            out = out.withColumn(name, F.greatest(f"_{name}", own))
    return out.drop(*[f"_{name}" for name in values])


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Add the row before as a struct of the ``order`` columns, null at a chromosome's first.

    Rows are marked by :func:`binned`; ``order`` is ascending, so the last row of a bin is
    the greatest struct, and the first row of a bin takes that of the bin before.
    """
    place, row = ["_bin", *keys], F.struct(*order)
    along = Window.partitionBy(*keys).orderBy("_bin")
    last = df.groupBy(*place).agg(F.max(row).alias("_last")).select(*place, F.lag("_last").over(along).alias("_last"))
    inside = Window.partitionBy("_bin", *keys).orderBy(*order)
    return df.join(last, place).withColumn(column, F.coalesce(F.lag(row).over(inside), F.col("_last"))).drop("_last")


def numbered(df: DataFrame, column: str = "nth", ties: Sequence[str] = ("chromEnd", "strand", "name")) -> DataFrame:
    """Number intervals from 1 along the genome, without bringing them to one task.

    Order: chromosome, start, then ``ties``.  The count of every bin is scanned in one
    small table; inside a bin rows are numbered on from there.
    """
    place = ["_bin", "chrom"]
    marked = binned(df)
    counts = marked.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*place, (F.sum("_n").over(Window.orderBy("chrom", "_bin")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_bin", "chrom").orderBy("chromStart", *[c for c in ties if c in df.columns])
    return marked.join(before, place).withColumn(column, F.col("_before") + F.row_number().over(inside)).select(*df.columns, column)
