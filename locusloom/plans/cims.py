"""Crosslink-induced mutation sites: permutation FDR over sites of one base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import site_counts
from ..operators.fdr import permutation_fdr, site_histogram
from ..operators.mutations import depth_at, simulate_sites
from ..storage import saved

#: Pairs (k, m) that are broadcast; more of them are shuffled.
MOST_PAIRS = 1_000_000


def read_offsets(tags: DataFrame, mutations: DataFrame) -> DataFrame:
    """Offsets of mutations from their read's 5' end, joined by the read's name.

    A mutation without exactly one read raises.  Returns ``offset`` and how often it is seen, ``n``.
    """
    named = tags.select(F.col("name").alias("_name"), F.col("chromStart").alias("_s"), F.col("chromEnd").alias("_e"))
    read = F.substring_index("name", "[", 1)
    joined = mutations.withColumn("_read", read).join(named, F.col("_read") == F.col("_name"))
    offset = F.when(F.col("strand") == "+", F.col("chromStart") - F.col("_s")).otherwise(F.col("_e") - F.col("chromEnd"))
    # The join is made once; what is left of it is a row for each offset of a read.
    found = saved(joined.groupBy(offset.alias("offset")).agg(F.count(F.lit(1)).alias("n")))
    counts = mutations.agg(F.count(F.lit(1)).alias("m")).crossJoin(found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("j"))).first()  # two totals
    if counts["m"] != counts["j"]:
        raise ValueError(f"{counts['m']} mutations but {counts['j']} with a read")
    return found


def mutation_sites(tags: DataFrame, mutations: DataFrame, iterations: int = 5, size: int = 1, fdr: float = 1.0, least_ratio: float = 0.0, empirical: bool = False, smooth: bool = True, seed: int = 1) -> DataFrame:
    """Sites whose mutations recur more often than random placement explains.

    m mutations at a site are compared with ``iterations`` placements of as many
    mutations on random tags, at equal depth k.  All iterations are one DataFrame with
    a column ``iteration``: clustering, depth and histograms run once, not in a loop.

    Returns BED columns and ``k``, ``m``, ``fdr`` and ``sites_ge``.
    """
    sized = mutations.where(F.col("chromEnd") - F.col("chromStart") == size)
    sites = saved(depth_at(site_counts(sized), tags, one_base=True if size == 1 else None))
    observed = site_histogram(sites)
    per_iteration = sized.count()
    offsets = read_offsets(tags, sized) if empirical else None
    drawn = simulate_sites(tags, per_iteration, iterations, seed, offsets)
    keys = ["iteration", "chrom", "chromStart", "strand"]
    simulated = site_histogram(depth_at(site_counts(drawn, keys), tags, one_base=True), ["iteration"])
    rates = permutation_fdr(observed, simulated, iterations, smooth)
    # A few pairs (k, m) hold most sites, so a shuffle by them would leave the sites to a few tasks.
    rates = saved(rates.select("k", "m", "fdr", "sites_ge"))
    out = sites.join(F.broadcast(rates) if rates.count() <= MOST_PAIRS else rates, ["k", "m"])
    name = F.concat("chrom", F.lit(":"), F.col("chromStart").cast("string"), "strand")
    kept = out.where((F.col("fdr") <= fdr) & (F.coalesce(F.try_divide(F.col("m").cast("double"), "k"), F.lit(-1.0)) >= least_ratio))
    return kept.select("chrom", "chromStart", "chromEnd", name.alias("name"), F.col("m").cast("double").alias("score"), "strand", "k", "m", "fdr", "sites_ge")
