"""Helpers that several operators share: durable intermediate tables and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_saved, saved

__all__ = ["MOST_SENT", "WORD", "drop_saved", "keep_one", "row_order", "saved", "shuffle_partitions", "spread", "uniform", "words_in"]

#: ASCII white space, the separators of words everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of identifiers and hashes that are broadcast at most.
MOST_SENT = 200_000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from a 64-bit hash, the same on every run."""
    return F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))


def words_in(text: Column) -> Column:
    """Words of a text, separated by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(ident: Column) -> Column:
    """A 64-bit hash that deals rows out: of the identifier, or of the row's place without one."""
    return F.when(ident.isNotNull(), F.xxhash64(ident)).otherwise(F.xxhash64(F.monotonically_increasing_id()))


def row_order(ident: str = "id", same: str = "same") -> Column:
    """Rows by identifier, null last, then by the hash of their text."""
    return F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), F.col(same).alias("same"))


def keep_one(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents but those of a group that do not stay.

    ``marked`` has a row for each document of a group: ``id``, ``same`` (hash of the text)
    and ``kept``, the :func:`row_order` of the one that stays.  Rows that repeat it are one
    row too.  What goes is broadcast if its count is small, else joined by identifier.
    """
    names = [F.col("id").alias("__id"), F.col("same").alias("__same")]
    lost = saved(marked.where(row_order() != F.col("kept")).select(*names).distinct())
    again = saved(marked.where(row_order() == F.col("kept")).groupBy("id", "same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*names))
    gone, repeats = lost.union(again), again.count()
    gone = F.broadcast(gone) if lost.count() + repeats <= MOST_SENT else gone

    def on(rows: DataFrame) -> Column:
        return docs[id_col].eqNullSafe(rows["__id"]) & (F.xxhash64(docs[text_col]) == rows["__same"])

    out = docs.join(gone, on(gone), "left_anti")
    if repeats:
        first = docs.join(again, on(again)).groupBy("__id", "__same").agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("doc"))
        out = out.union(first.select("doc.*"))
    return out
