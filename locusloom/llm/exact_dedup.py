"""Exact deduplication by a distributed sort of the contents."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, spread, uniform
from .splitters import quantiles, range_count, range_of, weighted_sample

#: Bytes of text in one range of the sort.
RANGE_BYTES = 32 << 20
#: Bytes of the text's start in the range key; a hash follows, which parts texts
#: that share their start.
KEY_BYTES = 16

# Every run of ASCII white space but a lone space, which is already what it becomes.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find equal texts and say which row of each group stays.

    Method: a size-weighted sample of keys (first bytes of the normalised text and a
    hash of it) gives splitters; records are partitioned by range, an external sort
    puts equal texts side by side, and the window compares whole neighbouring texts.
    A text that fills several ranges of the sample (a third of all rows may be one
    text) is cut by a hash of the identifier, or of the place of a row without one, into as
    many pieces; each piece is reduced to a minimum and a count, and the few pieces are combined afterwards.

    Returns one row per input row: ``doc`` (struct of the input's columns, whatever
    their names), ``keep_id``, ``group_size`` (long), ``kept`` (boolean) and
    ``text_sha256`` (lower-case hex of the normalised text in UTF-8).

    Edge cases: a null text counts as empty; null identifiers sort last, so they stay
    only in groups without any other; of rows that repeat identifier and text exactly
    one is kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    text, ident = F.col(f"doc.`{text_col}`"), F.col(f"doc.`{id_col}`")
    bytes_of = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    total = rows.agg(F.sum(bytes_of)).first()[0] or 0
    ranges = range_count(spark, total, RANGE_BYTES)

    def keyed(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("norm", normalised(text))
            .withColumn("head", F.hex(F.substring(F.encode("norm", "UTF-8"), 1, KEY_BYTES)))
            .withColumn("mix", F.xxhash64("norm"))
        )

    drawn = keyed(weighted_sample(rows, bytes_of, total, ranges, spread(ident))).select("head", "mix").collect()
    keys = [(r["head"], r["mix"]) for r in drawn]
    share = max(1, len(keys) // ranges)
    # Texts that would overfill a range, with the number of pieces for each.
    hot = [(mix, -(-n // share)) for (_, mix), n in Counter(keys).items() if n > 2 * share]
    key = F.struct(F.col("head").alias("h"), F.col("mix").alias("m"))
    bounds = [{"h": h, "m": m} for h, m in quantiles(keys, ranges)]
    placed = keyed(rows).withColumn("range", range_of(key, bounds, "struct<h:string,m:bigint>"))
    if hot:
        pieces = F.broadcast(spark.createDataFrame(hot, "mix long, pieces int"))  # under 1/2 of the ranges
        placed = placed.join(pieces, "mix", "left").withColumn("piece", F.coalesce(F.floor(uniform(spread(ident)) * F.col("pieces")), F.lit(0)))
    # The normalised text is made anew after the exchange rather than sent beside the text.
    # The window's partitions are parts of those of the exchange, so it needs no other.
    dealt = ["range", "piece"] if hot else ["range"]
    sent = placed.select("doc", "head", "mix", *dealt, *(["pieces"] if hot else [])).repartition(*dealt).withColumn("norm", normalised(text))
    same = Window.partitionBy(*dealt, "head", "mix", "norm").orderBy(ident.asc_nulls_last())
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grouped = sent.select(
        "doc", *(["piece", "pieces"] if hot else []),
        F.min(ident).over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        F.row_number().over(same).alias("nth"),
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
    )
    if hot:
        grouped = saved(grouped)
        merged = (
            grouped.where("pieces is not null and nth = 1")
            .groupBy("text_sha256")
            .agg(F.min("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"), F.min("piece").alias("first_piece"))
        )
        grouped = grouped.join(F.broadcast(merged), "text_sha256", "left")  # at most one row for each hot text
        # Without any identifier the first row of the group's first piece stays.
        stays = F.when(F.col("all_size").isNull(), F.col("nth") == 1).otherwise(
            (F.col("nth") == 1) & F.col("keep_id").eqNullSafe(F.col("all_keep")) & (F.col("all_keep").isNotNull() | (F.col("piece") == F.col("first_piece")))
        )
        return grouped.select("doc", F.coalesce("all_keep", "keep_id").alias("keep_id"), F.coalesce("all_size", "group_size").alias("group_size"), stays.alias("kept"), "text_sha256")
    return grouped.select("doc", "keep_id", "group_size", (F.col("nth") == 1).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies, with the columns they came with."""
    return exact_dedup(docs, id_col, text_col).where("kept").select("doc.*")
