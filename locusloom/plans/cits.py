"""Crosslink-induced truncation sites: clusters of read starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import cluster
from ..operators.geometry import flank_up
from ..operators.rows import matching_rows
from ..storage import saved
from .peaks import call_peaks


def truncation_sites(tags: DataFrame, mutations: DataFrame, p: float = 0.01, merge_gap: int = -1, multi_test: bool = False, highest: float = -1, prefix: str = "CITS") -> DataFrame:
    """Bases before read starts that gather more reads than their cluster explains.

    Reads with a mutation do not end at the crosslink and drop out; the others shrink to
    the base before their 5' end; clusters of at least three of the original reads serve
    as genes.  Reads cluster where they share a base: book-ended ones lie apart.
    """
    reads = mutations.select(F.substring_index("name", "[", 1).alias("name"))
    clean = matching_rows(tags, reads, "name", "name", keep=False)
    starts = flank_up(clean, -1, -1)
    areas = saved(cluster(tags, -1, stranded=True).where("score > 2").select("chrom", "chromStart", "chromEnd", "name", "score", "strand"))
    slim = starts.select("chrom", "chromStart", "chromEnd", "name", "score", "strand")
    return call_peaks(slim, areas, stranded=True, merge_gap=merge_gap, prefix=prefix, p=p, multi_test=multi_test, highest=highest)
