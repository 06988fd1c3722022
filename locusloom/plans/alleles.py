"""Allele counts at mutation sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mutations import depth_at, on_read_strand


def site_alleles(tags: DataFrame, mutations: DataFrame) -> DataFrame:
    """Reads by base at every substitution site: depth from the tags, the rest reference.

    The same as :func:`..operators.mutations.allele_counts` of the sites, with the alleles
    counted where the sites are: one group for each site, which then takes its depth.
    """
    spot = ["chrom", "chromStart", "chromEnd", "strand"]
    alt = on_read_strand(F.col("altBase"))
    subs = mutations.where("mtype = '>'").dropna(subset=spot)
    counted = subs.groupBy(*spot).agg(F.min("refBase").alias("refBase"), *[F.count(F.when(alt == b, 1)).alias(f"_{b}") for b in "ACGT"])
    sites = depth_at(counted, tags).withColumn("ref", on_read_strand(F.col("refBase")))
    rest = F.col("k") - (F.col("_A") + F.col("_C") + F.col("_G") + F.col("_T"))
    return sites.select(*spot, "k", "ref", *[F.when(F.col("ref") == b, F.col(f"_{b}") + rest).otherwise(F.col(f"_{b}")).alias(b) for b in "ACGT"])
