"""Operators on mutation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draw import drawn_below
from ..functions.seq import complement, reverse_complement
from ..storage import saved
from .ranks import base_depths, overlap_counts

#: Slices of the drawn numbers, by which offsets are looked up.
_SLICES = 4096
_KINDS = {"del": "-", "ins": "+", "sub": ">"}


def select_mutations(mutations: DataFrame, kind: str, change: str = "") -> DataFrame:
    """Deletions, insertions or substitutions; of these only ``change``, as in ``t2c``.

    A change is named on the read's strand; U counts as T; its middle character may be
    any, as in ``t>c``.
    """
    out = mutations.where(F.col("mtype") == _KINDS[kind])
    if not change:
        return out
    ref, alt = (c.upper().replace("U", "T") for c in (change[0], change[2]))
    read = lambda c: F.when(F.col("strand") == "-", reverse_complement(F.upper(c))).otherwise(F.upper(c))
    return out.where((read(F.col("refBase")) == ref) & (read(F.col("altBase")) == alt))


def on_read_strand(base: Column) -> Column:
    return F.when(F.col("strand") == "-", complement(F.upper(base))).otherwise(F.upper(base))


def mutation_summary(mutations: DataFrame) -> DataFrame:
    """Counts of deletions, insertions, substitutions, and of each change of bases."""
    kind = F.when(F.col("mtype") == "-", "deletion").when(F.col("mtype") == "+", "insertion").otherwise("substitution")
    change = F.when(F.col("mtype") == ">", F.concat(on_read_strand(F.col("refBase")), F.lit("-"), on_read_strand(F.col("altBase"))))
    marked = mutations.select(kind.alias("kind"), change.alias("change"))
    both = marked.select(F.col("kind"), F.explode(F.array_compact(F.array(F.lit("all"), "change"))).alias("change"))
    return both.groupBy("kind", "change").agg(F.count(F.lit(1)).alias("n"))


def split_deletions(mutations: DataFrame) -> DataFrame:
    """A row for every deleted base, its place and offset moved along."""
    size = F.when(F.col("mtype") == "-", F.length("refBase")).otherwise(1)
    out = mutations.withColumn("_i", F.explode(F.sequence(F.lit(0), size - 1)))
    gone = F.col("mtype") == "-"
    at = F.col("_i").cast("long")
    return (
        out.withColumn("chromStart", F.when(gone, F.col("chromStart") + at).otherwise(F.col("chromStart")))
        .withColumn("chromEnd", F.when(gone, F.col("chromStart") + 1).otherwise(F.col("chromEnd")))
        .withColumn("offset", F.when(gone, F.col("offset") + at).otherwise(F.col("offset")))
        .withColumn("refBase", F.when(gone, F.substring(F.col("refBase"), F.col("_i") + 1, F.lit(1))).otherwise(F.col("refBase")))
        .drop("_i")
    )


def position_histogram(mutations: DataFrame, offset: str = "offset") -> DataFrame:
    """How many mutations lie at each offset of the read."""
    return mutations.groupBy(offset).agg(F.count(F.lit(1)).alias("n"))


def allele_counts(sites: DataFrame, mutations: DataFrame, depth: str = "k", reference: str = "refBase") -> DataFrame:
    """For every site, its reads by base: A, C, G, T.

    Mutated bases are counted at the site and strand; the rest of the site's ``depth``
    reads have its reference base.  Bases are those of the read's strand.
    """
    keys = ["chrom", "chromStart", "chromEnd", "strand"]
    slim = mutations.where("mtype = '>'").select(*keys, on_read_strand(F.col("altBase")).alias("alt"))
    own = sites.select(*keys, depth, on_read_strand(F.col(reference)).alias("ref"))
    counted = slim.groupBy(*keys).pivot("alt", list("ACGT")).count()
    seen = own.join(counted, keys, "left")
    count = {b: F.coalesce(F.col(b), F.lit(0)) for b in "ACGT"}
    rest = F.col(depth) - (count["A"] + count["C"] + count["G"] + count["T"])
    return seen.select(*keys, depth, "ref", *[F.when(F.col("ref") == b, count[b] + rest).otherwise(count[b]).alias(b) for b in "ACGT"])


def simulate_sites(tags: DataFrame, per_iteration: int, iterations: int = 1, seed: int = 1, offsets: DataFrame | None = None) -> DataFrame:
    """Random one-base sites on random tags, ``per_iteration`` for each ``iteration``.

    Tags are drawn with replacement through their row number; the place is drawn evenly
    between the first and last base, or from ``offsets`` (column ``offset``, measured
    from the 5' end; with a column ``n`` each stands for so many), and then may fall beyond
    a shorter tag.
    """
    from .scan import numbered

    spark = tags.sparkSession
    # Rows alike in these four are alike in all that is drawn from them, so names would only be carried along.
    rows = numbered(tags.select("chrom", "chromStart", "chromEnd", "strand"), "_row").withColumn("_row", F.col("_row") - 1)
    count = tags.where("chrom IS NOT NULL AND chromStart IS NOT NULL").count()
    if not count:
        return rows.limit(0).withColumn("iteration", F.lit(0)).drop("_row")
    total = per_iteration * iterations
    draws = spark.range(total).select((F.col("id") / per_iteration).cast("int").alias("iteration"), drawn_below(F.lit(count), f"{seed}:tag", F.col("id")).alias("_row"), F.col("id").alias("site"))
    if offsets is None:
        placed = draws.join(rows, "_row")
        span = F.greatest(F.col("chromEnd") - F.col("chromStart") - 2, F.lit(1))
        place = drawn_below(span, f"{seed}:place", F.col("site")) + 1
    else:
        by_offset = offsets.groupBy("offset").agg(F.sum("n" if "n" in offsets.columns else F.lit(1)).alias("_n"))
        share = Window.orderBy("offset")  # one row for each offset of a read
        cuts = saved(by_offset.withColumn("_hi", F.sum("_n").over(share)).withColumn("_lo", F.col("_hi") - F.col("_n")))
        all_ = cuts.agg(F.max("_hi")).first()[0] or 0
        # A draw looks at the few cuts of its slice of [0, all), not at every one.
        slice_ = lambda p: F.floor(p * F.lit(_SLICES) / F.lit(max(all_, 1)))
        sliced = cuts.select("offset", "_lo", "_hi", F.explode(F.sequence(slice_(F.col("_lo")), slice_(F.col("_hi") - 1))).alias("_slice"))
        picked = draws.withColumn("_p", drawn_below(F.lit(all_), f"{seed}:place", F.col("site"))).withColumn("_slice", slice_(F.col("_p")))
        picked = picked.join(F.broadcast(sliced), ["_slice"]).where((F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_hi"))).select("iteration", "_row", "site", "offset")
        placed = picked.join(rows, "_row")
        place = F.col("offset")
    start = F.when(F.col("strand") == "+", F.col("chromStart") + place).otherwise(F.col("chromEnd") - 1 - place)
    start = F.greatest(start, F.lit(0))
    return placed.select("iteration", "chrom", start.alias("chromStart"), (start + 1).alias("chromEnd"), F.concat(F.lit("s"), F.col("site").cast("string")).alias("name"), F.lit(0.0).alias("score"), "strand")


def depth_at(sites: DataFrame, tags: DataFrame, one_base: bool | None = None) -> DataFrame:
    """``k``: tags of the strand that cover each site, spliced ones by their blocks.

    Sites of one base take their depth on the way through one window; ``one_base`` says that
    all are, unless given it is looked up.
    """
    plain = "blockSizes" not in tags.columns
    if plain and one_base is None:
        one_base = sites.where("chromEnd != chromStart + 1").select("chrom").isEmpty()
    if plain and one_base:
        return base_depths(sites, tags, stranded=True, column="k")
    counts = overlap_counts(sites, tags, stranded=True).withColumnRenamed("n", "k")
    return sites.join(counts, ["chrom", "chromStart", "chromEnd", "strand"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
