"""Collapse of duplicate reads, with and without random barcodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.em import barcode_mixtures
from ..model import barcode_in_name, copies_in_name, five_prime
from ..sources.tables import write_tsv
from ..storage import drop_saved, saved

_PLACE = ["chrom", "strand", "pos5"]


def _weighted(tags: DataFrame, weight: bool, weight_in_name: bool, barcoded: bool) -> DataFrame:
    copies = copies_in_name(with_barcode=barcoded) if weight_in_name else F.col("score")
    return tags.withColumn("copies", copies.cast("double") if weight else F.lit(1.0)).withColumn("pos5", five_prime())


def _preference(keep_max_score: bool) -> list[Column]:
    longest = F.desc(F.col("chromEnd") - F.col("chromStart"))
    return [F.desc("copies"), longest, F.asc("name")] if keep_max_score else [longest, F.asc("name")]


def collapse_5p(tags: DataFrame, weight: bool = False, weight_in_name: bool = False, keep_max_score: bool = False) -> DataFrame:
    """One tag for each 5' end of a strand: the longest, scored by the number of tags.

    With ``weight`` tags count by their score (or the copy number in their name), and
    ``keep_max_score`` lets the one with the most copies represent.  Ties go to the
    smaller name.  Each place is one group, reduced by a window that may spill.
    """
    marked = _weighted(tags, weight, weight_in_name, barcoded=False)
    group = Window.partitionBy(*_PLACE)
    out = marked.withColumn("_nth", F.row_number().over(group.orderBy(*_preference(keep_max_score)))).withColumn("_sum", F.sum("copies").over(group))
    return out.where("_nth = 1").withColumn("score", F.col("_sum")).select(*tags.columns)


def with_barcode(tags: DataFrame) -> DataFrame:
    """Use the column ``barcode``, or the last part of the name; keep barcodes of ACGT only."""
    if "barcode" not in tags.columns:
        tags = tags.withColumn("barcode", barcode_in_name())
    return tags.withColumn("barcode", F.upper("barcode")).where(F.col("barcode").rlike("^[ACGT]+$"))


def barcode_counts(tags: DataFrame, weight: bool = False, weight_in_name: bool = False) -> DataFrame:
    """Copies of every barcode at every place: what the error models work on."""
    marked = _weighted(with_barcode(tags), weight, weight_in_name, barcoded=True)
    return marked.groupBy(*_PLACE, "barcode").agg(F.sum("copies").alias("observed"))


def collapse_barcodes(tags: DataFrame, weight: bool = False, weight_in_name: bool = False, keep_max_score: bool = False) -> DataFrame:
    """One tag for each 5' end and barcode, scored by its copies, with ``observed``."""
    marked = _weighted(with_barcode(tags), weight, weight_in_name, barcoded=True)
    group = Window.partitionBy(*_PLACE, "barcode")
    out = marked.withColumn("_nth", F.row_number().over(group.orderBy(*_preference(keep_max_score)))).withColumn("observed", F.sum("copies").over(group))
    return out.where("_nth = 1").withColumn("score", F.col("observed")).select(*dict.fromkeys([*tags.columns, "barcode", "observed"]))


_FITTED = "n array<double>, reliability array<double>, error double, mismatches double, total double"


def _places(counts: DataFrame) -> DataFrame:
    """A row for every place: its distinct barcodes ``_names`` in order and their counts ``_seen``."""
    pairs = F.sort_array(F.collect_list(F.struct("barcode", "observed")))
    places = counts.groupBy(*_PLACE).agg(pairs.alias("_p"))
    return places.select(*_PLACE, F.transform("_p", lambda p: p["barcode"]).alias("_names"), F.transform("_p", lambda p: p["observed"]).alias("_seen"))


def _fit(error: float | None) -> Callable[[str, str], Column]:
    @F.pandas_udf(_FITTED)
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, observed in batches:
            yield pd.DataFrame(barcode_mixtures([list(b) for b in names], [list(c) for c in observed], error), columns=[c.split()[0] for c in _FITTED.split(", ")])

    return fit


def fit_barcodes(counts: DataFrame, error: float | None = None) -> DataFrame:
    """The barcode mixture of every place.

    A place's array holds its distinct barcodes with counts, already summed, so its size is
    bounded by the number of possible barcodes and not by the number of reads.  Places are
    fitted in Arrow batches of many; those with one barcode need no fit.
    """
    places = _places(counts)
    one = F.struct(
        F.col("_seen").alias("n"), F.array(F.lit(100.0)).alias("reliability"), F.lit(0.0).alias("error"), F.lit(0.0).alias("mismatches"), F.element_at("_seen", 1).alias("total")
    )
    single = places.where(F.size("_names") == 1).withColumn("f", one)
    several = places.where(F.size("_names") > 1).withColumn("f", _fit(error)("_names", "_seen"))
    rows = single.unionByName(several).select(*_PLACE, "_names", "f", F.explode(F.arrays_zip("_names", "_seen", "f.n", "f.reliability")).alias("r"))
    return rows.select(
        *_PLACE, F.col("r._names").alias("barcode"), F.col("r._seen").alias("observed"), F.col("r.n").alias("n"), F.col("r.reliability").alias("reliability"),
        F.size("_names").alias("k"), "f.total", "f.error", "f.mismatches", (F.col("f.total") * F.length(F.element_at("_names", 1))).alias("nucleotides"),
    )


def alignment_error_rate(tags: DataFrame, weight: bool = False) -> float:
    """Mismatches of all tags over their nucleotides; the score counts mismatches.

    With ``weight`` the copy number stands in the name and the score still counts them.
    """
    size = F.aggregate("blockSizes", F.lit(0).cast("long"), lambda n, s: n + s) if "blockSizes" in tags.columns else F.col("chromEnd") - F.col("chromStart")
    copies = copies_in_name(with_barcode=True) if weight else F.lit(1.0)
    wrong, all_ = tags.agg(F.sum(F.col("score") * copies), F.sum(size * copies)).first()
    return float(wrong / all_) if all_ else 0.0


def global_error_rate(tags: DataFrame, rounds: int = 3, start: float = 0.02, least: int = 50, **options) -> float:
    """Error rate that the mixtures of well covered places agree on: three jobs.

    Places are gathered once, a row for each; a round reads them and sums two numbers, it
    neither joins nor groups.
    """
    places = _places(barcode_counts(tags, **options)).withColumn("_n", F.aggregate("_seen", F.lit(0.0), lambda n, c: n + c)).where(F.col("_n") >= least)
    places = saved(places.select("_names", "_seen", (F.col("_n") * F.length(F.element_at("_names", 1))).alias("nucleotides")))
    whole = places.agg(F.sum("nucleotides")).first()[0]  # places of one barcode have no mismatches
    several = places.where(F.size("_names") > 1)
    error = start
    for _ in range(rounds):
        if not whole:
            break
        wrong = several.select(_fit(error)("_names", "_seen").alias("f")).agg(F.sum("f.mismatches")).first()[0]
        error = max((wrong or 0.0) / whole, 1e-12)
    drop_saved(places)
    return float(error)


def collapse_em(tags: DataFrame, threshold: float, error_model: str = "alignment", weight: bool = False, weight_in_name: bool = False, keep_max_score: bool = False) -> DataFrame:
    """Collapse by 5' end and barcode, keeping barcodes that misreadings do not explain.

    ``error_model``: ``alignment``, ``em-global``, ``em-local`` or ``fix=x``.  A place
    where no barcode reaches ``threshold`` keeps its best one with score 100; of those alike
    to the sixth place the smallest.
    """
    options = dict(weight=weight, weight_in_name=weight_in_name)
    if error_model == "alignment":
        error = max(alignment_error_rate(tags, weight_in_name), 1e-12)
    elif error_model == "em-global":
        error = global_error_rate(tags, **options)
    elif error_model == "em-local":
        error = None
    elif error_model.startswith("fix="):
        error = float(error_model[4:])
    else:
        raise ValueError(f"unknown error model {error_model!r}")
    fitted = fit_barcodes(barcode_counts(tags, **options), error)
    rank = Window.partitionBy(*_PLACE).orderBy(F.desc(F.round("reliability", 6)), F.desc(F.round("n", 6)), "barcode")
    best = fitted.withColumn("_nth", F.row_number().over(rank)).withColumn("reliability", F.when((F.col("_nth") == 1) & (F.col("reliability") < threshold), 100.0).otherwise(F.col("reliability")))
    kept = best.where(F.col("reliability") >= threshold).select(*_PLACE, "barcode", "n", "reliability", "error")
    one = collapse_barcodes(tags, keep_max_score=keep_max_score, **options).withColumn("pos5", five_prime())
    out = one.join(kept, [*_PLACE, "barcode"]).withColumn("score", F.round("reliability", 2))
    return out.select(*dict.fromkeys([*tags.columns, "barcode", "observed", "n", "reliability", "error"]))


def mixture_diagnostics(tags: DataFrame, error: float | None = None, weight: bool = False, weight_in_name: bool = False) -> DataFrame:
    """Of every place with several barcodes: how many (``k``), reads (``N``) and error rate (``e``)."""
    fitted = fit_barcodes(barcode_counts(tags, weight, weight_in_name), error)
    return fitted.where("k > 1").groupBy(*_PLACE).agg(F.max("k").alias("k"), F.max("total").alias("N"), F.max("error").alias("e"))


def write_diagnostics(diagnostics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``k``, ``N`` and ``e`` of each place as tab-separated lines."""
    write_tsv(diagnostics.select("k", "N", "e"), path, mode=mode)
