"""Peaks of read coverage: candidates, valleys, significance per gene."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.stats import scan_p
from ..functions.valley import View, look, merged
from ..model import blocks, strand_keys
from ..operators.cluster import best_per_island
from ..operators.coverage import exact_coverage
from ..operators.overlap import overlap_join
from ..operators.scan import binned, numbered, with_previous
from ..storage import saved

#: Coordinates of one bin, which bounds the steps that a task holds.
VALLEY_BIN = 1 << 17
_LOWS = "array<struct<height:double,edge:bigint,start:bigint>>"


def _stretches(table: pa.Table) -> tuple[list[slice], dict[str, np.ndarray]]:
    """The steps of a bin in order, and the stretches that they form: coverage breaks off between.

    A maximum has no higher step before it and a lower one, or none, after; a plateau counts at its last step.
    """
    start, end, height = (table.column(c).to_numpy() for c in ("chromStart", "chromEnd", "score"))
    order = np.argsort(start)
    start, end, height = start[order], end[order], height[order]
    before, after = (table.column(c)[0].as_py() for c in ("before", "after"))
    apart = start[1:] != end[:-1]
    # All stretches at once: beyond either end of a stretch lies nothing.
    left, right = np.full(len(height), -np.inf), np.full(len(height), -np.inf)
    left[1:], right[:-1] = np.where(apart, -np.inf, height[:-1]), np.where(apart, -np.inf, height[1:])
    left[0], right[-1] = (-np.inf if x is None else x for x in (before, after))
    cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(height)]
    parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
    return parts, dict(start=start, end=end, height=height, maxima=(height > right) & (height >= left))


def _walk(view: View, steps: dict[str, np.ndarray], part: slice, forward: bool) -> dict[int, tuple]:
    """Look back along a stretch, or with ``forward`` ahead: then its steps come in reverse."""
    s, e, h, maxima = (steps[c][part] for c in ("start", "end", "height", "maxima"))
    if not forward:
        return look(view, h, e - s, s, e, maxima, False)
    found = look(view, h[::-1], (e - s)[::-1], s[::-1], s[::-1], maxima[::-1], True)
    return {len(h) - 1 - i: f for i, f in found.items()}


def _lists(lows: tuple[list[tuple], ...]) -> pa.Array:
    """The lower steps of each maximum as one array, made from whole columns."""
    flat = [low for some in lows for low in some]
    heights, edges, starts = zip(*flat) if flat else ((), (), ())
    values = pa.StructArray.from_arrays([pa.array(heights, pa.float64()), pa.array(edges, pa.int64()), pa.array(starts, pa.int64())], names=["height", "edge", "start"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lows)]), pa.int32()), values)


def _summaries(rows: DataFrame, keys: list[str], kinds: str) -> DataFrame:
    """For every bin the views that its two ends leave, and whether one stretch fills it."""

    def summary(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in (*keys, "_bin", "before", "after")}
        parts, steps = _stretches(table)
        back, ahead = View(), View()
        _walk(back, steps, parts[-1], False)
        _walk(ahead, steps, parts[0], True)
        row = {c: first[c] for c in (*keys, "_bin")}
        row |= dict(through=len(parts) == 1, joins_left=first["before"] is not None, joins_right=first["after"] is not None, back=pickle.dumps(back), ahead=pickle.dumps(ahead))
        return pa.Table.from_pylist([row])

    return rows.groupBy(*keys, "_bin").applyInArrow(summary, f"{kinds}, _bin bigint, through boolean, joins_left boolean, joins_right boolean, back binary, ahead binary")


def _carried(summaries: DataFrame, keys: list[str], kinds: str) -> DataFrame:
    """What each bin sees beyond its ends: views merged along the chromosome, a row for each bin."""

    def scan(table: pa.Table) -> pa.Table:
        bins = sorted(table.to_pylist(), key=lambda r: r["_bin"])
        for way, joined, ties, order in (("back", "joins_left", False, bins), ("ahead", "joins_right", True, bins[::-1])):
            view = View()
            for r in order:
                seen = view if r[joined] else View()
                own = pickle.loads(r[way])
                view = merged(seen, own, ties) if r["through"] and r[joined] else own
                r[f"far_{way}"] = pickle.dumps(seen)
        return pa.Table.from_pylist([{c: r[c] for c in (*keys, "_bin", "far_back", "far_ahead")} for r in bins])

    return summaries.groupBy(*keys).applyInArrow(scan, f"{kinds}, _bin bigint, far_back binary, far_ahead binary")


def valley_peaks(coverage: DataFrame, depth: float = 0.9, least: float = 2.0, stranded: bool = True) -> DataFrame:
    """Local maxima that valleys set apart, with their bounds and half-height extents.

    A maximum is a peak if, on each side, a step of at most ``1 - depth`` of its height lies
    before the nearest maximum that outranks it, or coverage breaks off before one comes.
    Its bounds are the lowest steps towards its neighbours, its half-height extent the first
    steps at or below half.

    Steps are taken in bins of coordinates (see :mod:`..functions.valley`): each bin gives the
    stacks that are seen from its ends, these are merged along the chromosome, and each bin is
    then walked once more from what lies beyond it.  A stretch of any length is as many tasks
    as it has bins, and no task holds more than one bin's steps.
    """
    keys = strand_keys(stranded)
    kinds = ", ".join(f"{k} string" for k in keys)
    steps = binned(coverage.select(*keys, "chromStart", "chromEnd", F.col("score").cast("double").alias("score")), width=VALLEY_BIN)
    along = Window.partitionBy(*keys).orderBy("_bin")
    step = F.struct("chromStart", "chromEnd", "score")
    ends = steps.groupBy(*keys, "_bin").agg(F.min(step).alias("head"), F.max(step).alias("tail")).select("*", F.lag("tail").over(along).alias("l"), F.lead("head").over(along).alias("r"))
    ends = ends.select(*keys, "_bin", F.when(F.col("l.chromEnd") == F.col("head.chromStart"), F.col("l.score")).alias("before"), F.when(F.col("tail.chromEnd") == F.col("r.chromStart"), F.col("r.score")).alias("after"))
    rows = steps.join(ends, [*keys, "_bin"])
    carried = _carried(_summaries(rows, keys, kinds), keys, kinds)

    def choose(table: pa.Table, beyond: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in keys}
        parts, steps = _stretches(table)
        far_back, far_ahead = (pickle.loads(beyond.column(c)[0].as_py()) for c in ("far_back", "far_ahead"))
        out = []
        for i, part in enumerate(parts):
            back = _walk(far_back if i == 0 else View(), steps, part, False)
            ahead = _walk(far_ahead if i == len(parts) - 1 else View(), steps, part, True)
            for t, (limit, low, lows) in back.items():
                at = part.start + t
                height = float(steps["height"][at])
                next_limit, next_low, next_lows = ahead[t]
                if all(far is None or least / height <= 1 - depth for far, least in ((limit, low), (next_limit, next_low))):
                    out.append((int(steps["start"][at]), int(steps["end"][at]), height, lows, next_lows))
        starts, ends, heights, *sides = zip(*out) if out else [()] * 5
        columns = [*(pa.array([first[k]] * len(out), pa.string()) for k in keys), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(heights, pa.float64()), *map(_lists, sides)]
        return pa.Table.from_arrays(columns, names=arrow.names).cast(arrow)

    schema = f"{kinds}, chromStart bigint, chromEnd bigint, score double, lows {_LOWS}, next_lows {_LOWS}"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    found = saved(rows.groupBy(*keys, "_bin").cogroup(carried.groupBy(*keys, "_bin")).applyInArrow(choose, schema))
    # A neighbouring peak ends the search too, wherever it lies.
    named = with_previous(binned(found), keys, ["chromStart"], "_prior").drop("_bin").withColumn("_away", -F.col("chromStart"))
    named = with_previous(binned(named, "_away"), keys, ["_away"], "_later").drop("_bin")
    inner = F.filter("lows", lambda s: F.col("_prior").isNull() | (s["start"] > F.col("_prior.chromStart")))
    outer = F.filter("next_lows", lambda s: F.col("_later").isNull() | (s["start"] < -F.col("_later._away")))
    half = F.col("score") / 2
    bounds = {}
    for side, lows, own in (("left", inner, "chromStart"), ("right", outer, "chromEnd")):
        bounds[side] = F.coalesce(F.get(lows, F.size(lows) - 1)["edge"], F.col(own))
        bounds[f"half_{side}"] = F.coalesce(F.get(F.filter(lows, lambda s: s["height"] <= half), F.lit(0))["edge"], bounds[side])
    strand = F.col("strand") if stranded else F.lit("+")
    peaks = named.select("chrom", strand.alias("strand"), "chromStart", "chromEnd", "score", *[bounds[c].alias(c) for c in ("left", "right", "half_left", "half_right")])
    return peaks.where(F.col("score") >= least)


def step_peaks(coverage: DataFrame, least: float = 2.0) -> DataFrame:
    """Every step of coverage at or above ``least`` as a candidate with its own bounds."""
    out = coverage.where(F.col("score") >= max(least, 2.0))
    if "strand" not in coverage.columns:
        out = out.withColumn("strand", F.lit("+"))
    s, e = F.col("chromStart"), F.col("chromEnd")
    return out.select("chrom", "strand", "chromStart", "chromEnd", "score", s.alias("left"), e.alias("right"), s.alias("half_left"), e.alias("half_right"))


def gene_background(tags: DataFrame, genes: DataFrame, stranded: bool, expression: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Size, tags and expected peak height of each gene, and the mean size of a tag.

    A tag that touches two exons counts twice.  With ``expression`` (``name``,
    ``expr``) all tags are shared out by expression instead of the gene's own count.
    """
    parts = genes.select(F.col("name").alias("gene"), "chrom", "strand", F.explode(blocks(genes)).alias("_b")).select("gene", "chrom", "strand", F.col("_b.s").alias("chromStart"), F.col("_b.e").alias("chromEnd"))
    need = [c for c in ("chrom", "chromStart", "chromEnd", "strand", "blockSizes", "blockStarts") if c in tags.columns]
    hits = overlap_join(tags.select(*need), parts, stranded).groupBy(F.col("region_gene").alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("gene").agg(F.sum(F.col("chromEnd") - F.col("chromStart")).alias("size"))
    counted = sizes.join(hits, "gene", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tag_size = tags.agg(F.avg(F.col("chromEnd") - F.col("chromStart"))).first()[0] or 0.0
    if expression is None:
        return counted.withColumn("expected", F.col("n") / F.col("size") * tag_size).withColumn("active", F.col("n") > 0), tag_size
    known = counted.join(expression.select(F.col("name").alias("gene"), "expr"), "gene")
    totals = known.agg(F.sum("n").alias("_n"), F.sum("expr").alias("_x"))
    shared = known.crossJoin(F.broadcast(totals))  # one row
    expected = F.coalesce(F.try_divide(F.col("_n") * F.col("expr"), "_x") / F.col("size") * tag_size, F.lit(0.0))
    return shared.withColumn("expected", expected).withColumn("active", F.col("expr") > 0).drop("_n", "_x", "expr"), tag_size


def significant_peaks(
    candidates: DataFrame, tags: DataFrame, genes: DataFrame, p: float = 0.01, stranded: bool = True, multi_test: bool = False,
    highest: float = -1, skip_out_of_range: bool = False, expression: DataFrame | None = None,
) -> DataFrame:
    """Peaks above what a gene's tags give by chance, by the scan statistic.

    A peak in two genes gives two rows, one outside all genes none.  The p-value is
    computed once for each distinct gene background and height.  Peaks above ``highest``
    (if positive) have a null p and stay unless ``skip_out_of_range``.
    """
    background, tag_size = gene_background(tags, genes, stranded, expression)
    named = overlap_join(candidates, genes.select("chrom", "chromStart", "chromEnd", "name", "strand"), stranded)
    keep = [*candidates.columns, F.col("region_name").alias("gene")]
    rows = named.select(*keep).join(background.where("expected > 0"), "gene").where(F.col("score") > F.col("expected"))
    ranged = F.lit(True) if highest <= 0 else F.col("score") <= highest
    distinct = rows.where(ranged).select("score", "expected", "size").distinct()
    tested = distinct.withColumn("p", scan_p(F.col("score"), F.col("expected"), F.col("size") / F.lit(tag_size)))
    out = rows.join(tested, ["score", "expected", "size"], "left" if highest > 0 and not skip_out_of_range else "inner")
    if multi_test:
        active = background.agg(F.sum(F.col("active").cast("long")).alias("_active"))
        out = out.crossJoin(F.broadcast(active)).withColumn("p", F.col("p") * F.col("_active")).drop("_active")  # one row
    out = out.withColumn("p", F.when(F.col("p") == 0, 1e-100).otherwise(F.col("p")))
    return out.where(F.col("p").isNull() | (F.col("p") <= p))


def call_peaks(
    tags: DataFrame, genes: DataFrame | None = None, valley: bool = False, depth: float = 0.9, least: float = 2.0, stranded: bool = True,
    merge_gap: int = -1, prefix: str = "Peak", **significance,
) -> DataFrame:
    """Coverage, candidates, significance, merging and numbering in one.

    Without ``genes`` candidates are valley peaks and all of them are returned.
    """
    if genes is None and not valley:
        raise ValueError("give genes, or set valley")
    # Later steps scan these tables several times; they are written once, cut to few columns.
    coverage = saved(exact_coverage(tags, stranded))
    found = valley_peaks(coverage, depth, max(least, 2.0), stranded) if valley else step_peaks(coverage, least)
    if genes is not None:
        found = significant_peaks(found, tags, genes, stranded=stranded, **significance)
    if merge_gap >= 0:
        found = best_per_island(found.withColumn("name", F.lit("")), "maxScore", merge_gap, same_strand=stranded).drop("name")
    found = saved(found)
    order = ("chromEnd", "strand", *(["gene"] if genes is not None else []))
    name = F.concat(F.lit(f"{prefix}_"), F.col("nth").cast("string"))
    return numbered(found, "nth", order).withColumn("name", name).drop("nth")


def peak_track(peaks: DataFrame, which: str = "peak") -> DataFrame:
    """BED6 of the peaks, of their ``bounds`` or of their ``half`` height extents."""
    start, end = {"peak": ("chromStart", "chromEnd"), "bounds": ("left", "right"), "half": ("half_left", "half_right")}[which]
    return peaks.select("chrom", F.col(start).alias("chromStart"), F.col(end).alias("chromEnd"), "name", "score", "strand")


def highest_first(peaks: DataFrame, per: list[str]) -> DataFrame:
    """The highest peak of each group."""
    rank = Window.partitionBy(*per).orderBy(F.desc("score"), "chrom", "chromStart", "strand")
    return peaks.withColumn("_nth", F.row_number().over(rank)).where("_nth = 1").drop("_nth")
