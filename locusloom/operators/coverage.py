"""Coverage along the coordinate axis: exact, by hopping window, normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import blocks, strand_keys
from .overlap import stretched
from .scan import BIN, binned, running


def exact_coverage(tags: DataFrame, stranded: bool = False, weight: Column | None = None, ext5: int = 0, ext3: int = 0) -> DataFrame:
    """Stretches of constant coverage above zero, as intervals with ``score``.

    Every block adds its weight at its start and takes it away at its end; positions are
    summed, run along the chromosome in bins (see :mod:`.scan`), and each stretch ends
    at the next position at which anything changes.
    """
    keys = strand_keys(stranded)
    tags = stretched(tags, ext5, ext3)
    value = (weight if weight is not None else F.lit(1)).cast("double")
    ends = lambda s, e, w: F.array(F.struct(s.alias("pos"), w.alias("d")), F.struct(e.alias("pos"), (-w).alias("d")))
    if "blockSizes" in tags.columns:
        steps = tags.select(*keys, value.alias("_w"), F.explode(blocks(tags)).alias("_b"))
        steps = steps.select(*keys, F.explode(ends(F.col("_b.s"), F.col("_b.e"), F.col("_w"))).alias("_s"))
    else:
        steps = tags.select(*keys, F.explode(ends(F.col("chromStart"), F.col("chromEnd"), value)).alias("_s"))
    # Nulls drop out here: the join below would drop them on one side only, and the steps be summed once for each side.
    steps = steps.select(*keys, "_s.pos", "_s.d").dropna(subset=[*keys, "pos"]).groupBy(*keys, "pos").agg(F.sum("d").alias("d")).where(F.abs("d") > 1e-6)
    placed = binned(steps, "pos")
    # What a bin starts from, and where the stretch that leaves it ends: at the first change of a later bin.
    along = Window.partitionBy(*keys).orderBy("_bin")
    sums = placed.groupBy("_bin", *keys).agg(F.sum("d").alias("_sum"), F.min("pos").alias("_head"))
    sums = sums.select("_bin", *keys, F.sum("_sum").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_base"), F.lead("_head").over(along).alias("_next"))
    inside = Window.partitionBy("_bin", *keys).orderBy("pos")
    own = F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = placed.join(sums, ["_bin", *keys]).select(*keys, "pos", F.coalesce(F.lead("pos").over(inside), F.col("_next")).alias("chromEnd"), (F.coalesce("_base", F.lit(0)) + own).alias("score"))
    return out.where(F.col("score") > 1e-6).select(*keys, F.col("pos").alias("chromStart"), "chromEnd", "score")


def normalised(coverage: DataFrame, tags: DataFrame, how: str = "none", factor: float = 1.0, window: int | None = None) -> DataFrame:
    """Scale coverage: ``none``, ``multiply`` by ``factor``, or ``rpkm``.

    Per million tags and kilobase, exact coverage divides by the nucleotides of all tags
    (blocks, if spliced), windows by all tags and the window's size.
    """
    if how == "none":
        return coverage
    if how == "multiply":
        return coverage.withColumn("score", F.col("score") * factor)
    if how != "rpkm":
        raise ValueError(f"unknown normalisation {how!r}")
    size = F.aggregate(blocks(tags), F.lit(0).cast("long"), lambda n, b: n + b["e"] - b["s"])
    total = tags.agg(F.sum(size if window is None else F.lit(window)).alias("_total"))
    scaled = coverage.crossJoin(F.broadcast(total))  # one row
    return scaled.withColumn("score", F.try_divide(F.col("score") * 1e9, F.col("_total"))).drop("_total")


def hopping_windows(tags: DataFrame, lengths: DataFrame, width: int = 100, step: int = 20, stranded: bool = False, nonzero: bool = False, ext5: int = 0, ext3: int = 0) -> DataFrame:
    """Tags that overlap each window ``[i * step, i * step + width)`` inside a chromosome.

    ``lengths`` has ``chrom`` and ``length``.  A tag is two steps, up at the first window it
    meets and down after the last, and a spliced one two more around the windows that lie
    in an intron; steps are summed by window and run along the chromosome.  So the width
    multiplies no rows, and windows are written out at the end only.  Scores are summed to
    twelve decimals, which sums of steps keep exact.  ``lengths`` is broadcast, a row for each
    chromosome: a shuffle by chromosome would sort all tags in as few tasks as those.

    Returns ``n``, ``total`` and ``mean`` score for each window, zeros included unless
    ``nonzero``.
    """
    keys = strand_keys(stranded)
    tags = stretched(tags, ext5, ext3)
    lengths = lengths.where(F.col("length") >= width).withColumn("_last", F.floor((F.col("length") - width) / step))
    lowest = F.greatest(F.floor((F.col("chromStart") - width) / step) + 1, F.lit(0))
    highest = F.least(F.floor((F.col("chromEnd") - 1) / step), F.col("_last"))
    score = (F.col("score") if "score" in tags.columns else F.lit(1.0)).cast("decimal(27,12)")
    met = tags.withColumn("_score", score).join(F.broadcast(lengths), "chrom").withColumn("_lo", lowest).withColumn("_hi", highest).where("_lo <= _hi")

    def change(window: Column, n: int) -> Column:
        return F.struct(window.cast("long").alias("window"), F.lit(n).alias("d"))

    changes = F.array(change(F.col("_lo"), 1), change(F.col("_hi") + 1, -1))
    if "blockSizes" in tags.columns:
        inner = F.transform(_gaps(blocks(tags)), lambda gap: F.struct(F.greatest(F.ceil(gap["s"] / step), F.col("_lo")).alias("lo"), F.least(F.floor((gap["e"] - width) / step), F.col("_hi")).alias("hi")))
        held = F.filter(inner, lambda g: g["lo"] <= g["hi"])
        changes = F.concat(changes, F.flatten(F.transform(held, lambda g: F.array(change(g["lo"], -1), change(g["hi"] + 1, 1)))))
    steps = met.select(*keys, "_score", F.explode(changes).alias("_c")).select(*keys, "_c.window", F.col("_c.d").alias("n"), (F.col("_c.d") * F.col("_score")).cast("decimal(38,12)").alias("total"))
    # Every bin of windows has a first row, so that no stretch between changes spans bins.
    edges = lengths.select("chrom", F.explode(F.concat(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"), F.lit(BIN).cast("long")), F.array((F.col("_last") + 1).cast("long")))).alias("window"))
    if stranded:
        edges = edges.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    edges = edges.select(*keys, "window", F.lit(0).alias("n"), F.lit(0).cast("decimal(38,12)").alias("total"))
    placed = binned(steps.union(edges).groupBy(*keys, "window").agg(F.sum("n").alias("dn"), F.sum("total").cast("decimal(38,12)").alias("dtotal")), "window", BIN)
    summed = running(placed, keys, ["window"], {"n": ("sum", F.col("dn")), "total": ("sum", F.col("dtotal"))})
    along, inside = Window.partitionBy(*keys).orderBy("_bin"), Window.partitionBy(*keys, "_bin").orderBy("window")
    heads = placed.groupBy(*keys, "_bin").agg(F.min("window").alias("_head")).select(*keys, "_bin", F.lead("_head").over(along).alias("_next"))
    runs = summed.join(heads, [*keys, "_bin"]).withColumn("_end", F.coalesce(F.lead("window").over(inside), F.col("_next"))).where("_end IS NOT NULL")
    if nonzero:
        runs = runs.where("n > 0")
    each = runs.select(*keys, F.explode(F.sequence(F.col("window"), F.col("_end") - 1)).alias("window"), F.col("n").cast("long").alias("n"), F.col("total").cast("double").alias("total"))
    return each.select(
        *keys, (F.col("window") * step).alias("chromStart"), (F.col("window") * step + width).alias("chromEnd"),
        F.concat(F.lit("w"), F.col("window").cast("string")).alias("name"), "n", "total", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("mean"),
    )


def _gaps(parts: Column) -> Column:
    """The introns between an interval's blocks."""
    return F.zip_with(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 2, F.size(parts)), lambda a, b: F.struct(a["e"].alias("s"), b["s"].alias("e")))
