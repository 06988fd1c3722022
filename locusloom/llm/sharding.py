"""Sharding into near-equal parts by sampled splitters and exact prefix sums."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, spread, uniform
from .splitters import SAMPLES_PER_RANGE, quantiles, range_count, range_of, weighted_sample

#: Bytes of the slim records (not of texts) in one range.
RANGE_BYTES = 16 << 20
SLIM_BYTES = 48


def shard_documents(docs: DataFrame, shards: int = 24, law: str = "bytes", together: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give every document a shard and a place in it.

    Law ``bytes``: each shard has the same bytes but for the documents at its two
    ends.  Law ``rows``: counts differ by one at most.

    Method: the key is a hash of the text, so equal texts are neighbours.  A sample
    of keys, weighted by size, gives quantile boundaries; records go to ranges by
    binary search, an overfull range is cut further by a hash (of the identifier where
    one text fills it: it may hold a third of all rows), and exact prefix sums over the ranges and
    within them give each record its position among all bytes or rows, hence its
    shard and its gapless slot.  Only identifiers, sizes and hashes are shuffled.
    Under ``bytes`` a group of equal texts stays in one shard unless it holds more
    than ``together`` of a shard's bytes.

    Returns the identifier, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``,
    ``law``, ``shard``, ``slot`` and ``grown_shard`` (null: these laws say nothing
    about another shard count).

    Edge cases: a null text has no bytes and the checksum of the empty text; null
    identifiers are allowed, and rows without one that have equal texts take any order among
    themselves; rows that repeat identifier and text take neighbouring
    slots; an empty table gives an empty result.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    slim = saved(
        docs.select(
            docs[id_col].alias("id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.xxhash64(text).alias("key"),
            spread(docs[id_col]).alias("tie"),
        )
    )
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    total, count = slim.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count(F.lit(1))).first()
    ranges = range_count(spark, count * SLIM_BYTES, RANGE_BYTES)
    keys = [r[0] for r in weighted_sample(slim, weight, total, ranges, F.col("tie")).select("key").collect()]
    hot = [k for k, n in Counter(keys).items() if n > 2 * SAMPLES_PER_RANGE and k < (1 << 63) - 1]
    bounds = sorted({*quantiles(keys, ranges), *hot, *(k + 1 for k in hot)})  # a heavy text has a range of its own
    ranged = slim.withColumn("range", range_of(F.col("key"), bounds, "bigint"))

    # Overfull ranges are cut into slices of a hash: of the key, which keeps equal texts
    # together, or of the identifier where the range is one text.
    mean = max(1, count // ranges)
    full = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), (F.min("key") == F.max("key")).alias("single"))
    full = full.select("range", F.when(F.col("n") > 2 * mean, F.ceil(F.col("n") / mean)).otherwise(1).alias("slices"), ((F.col("n") > 2 * mean) & F.col("single")).alias("split"))
    cut = (
        ranged.join(F.broadcast(full), "range")  # a row for each range, twice MOST_RANGES at most
        .withColumn("spread", F.when(F.col("split"), F.col("tie")).otherwise(F.xxhash64("key", F.lit("slice"))))
        .withColumn("slice", F.floor(uniform(F.col("spread")) * F.col("slices")))
        .withColumn("first", F.when(F.col("split"), F.shiftrightunsigned("tie", 1)).otherwise(F.col("key")))
    )
    order = Window.orderBy("range", "slice")  # over the table of pieces alone
    pieces = cut.groupBy("range", "slice").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
    pieces = pieces.select("range", "slice", (F.sum("w").over(order) - F.col("w")).alias("w0"), (F.sum("n").over(order) - F.col("n")).alias("n0"))
    within = Window.partitionBy("range", "slice").orderBy("first", "key", "tie", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "slice", "key").orderBy("first", "key", "tie", "id", "size")
    placed = (
        cut.join(F.broadcast(pieces), ["range", "slice"])  # at most two for each range
        .repartition("range", "slice")
        .withColumn("before", F.col("w0") + F.sum(weight).over(within) - weight)
        .withColumn("row", F.col("n0") + F.row_number().over(within) - 1)
    )
    if law == "bytes":
        whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        placed = placed.withColumn("group_at", F.min("before").over(whole)).withColumn("group_size", F.sum("size").over(whole))
        small = ~F.col("split") & (F.col("group_size") <= F.lit(int(total * together / shards)))
        placed = placed.withColumn("twice", F.when(small, 2 * F.col("group_at") + F.col("group_size")).otherwise(2 * F.col("before") + F.col("size")))
        shard = F.expr(f"least((twice * {shards}) div {max(1, 2 * total)}, {shards - 1})")
    else:
        shard = F.expr(f"least((row * {shards}) div {max(1, count)}, {shards - 1})")
    placed = saved(placed.select("id", "size", "crc", "row", shard.cast("int").alias("shard")))
    starts = placed.groupBy("shard").agg(F.min("row").alias("start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard",
        (F.col("row") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
