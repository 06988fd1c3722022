"""Steps that once grew faster than their input, or left it to a few tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.functions import em
from locusloom.operators import collapse, coverage, geometry, mutations, ranks
from locusloom.operators.cluster import site_counts
from locusloom.plans import alleles, annotate, cims

BED = "chrom string, chromStart long, chromEnd long, name string, score double, strand string"


@pytest.fixture
def no_broadcast(spark):
    """Only what the code itself broadcasts is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tags(spark, n=300, reach=60_000, longest=90):
    rng = random.Random(5)
    rows = [("c", s, s + rng.randrange(longest), f"t{i}", 1.0, rng.choice("+-")) for i, s in enumerate(rng.choices(range(reach), k=n))]
    return spark.createDataFrame([*rows, ("c", 10, 50_000, "long", 1.0, "+"), ("c", 16_384, 32_768, "bins", 1.0, "+"), (None, 1, 9, "none", 1.0, "+"), ("d", 9, 4, "back", 1.0, "+")], BED)


def test_depths_of_bases_equal_pairs(spark):
    reads = tags(spark)
    places = [("c", s, s + 1, "s", 0.0, x) for s in (0, 10, 16_383, 16_384, 32_767, 32_768, 49_999, 50_000, 70_000) for x in "+-"] + [("d", 5, 6, "s", 0.0, "+"), ("e", 1, 2, "s", 0.0, "+"), (None, 1, 2, "s", 0.0, "+")]
    places += [("c", r["chromStart"] + 1, r["chromStart"] + 2, "s", 0.0, r["strand"]) for r in reads.where("chrom = 'c'").collect()]
    sites = site_counts(spark.createDataFrame(places, BED))
    held = [r for r in reads.collect() if r["chrom"]]
    got = mutations.depth_at(sites, reads).collect()
    assert len(got) == sites.count()
    for r in got:
        assert r["k"] == sum(t["chrom"] == r["chrom"] and t["strand"] == r["strand"] and t["chromStart"] <= r["chromStart"] < t["chromEnd"] for t in held)


def test_sites_take_their_depth_on_the_way(spark, no_broadcast):
    """Sites are computed once and not joined back; wider ones are still counted by ranks."""
    sites, reads = site_counts(tags(spark).withColumn("chromEnd", F.col("chromStart") + 1)), tags(spark)
    found = mutations.depth_at(sites, reads)
    assert "Join" not in plan(found)
    wide = mutations.depth_at(site_counts(reads.where("chromEnd > chromStart")), reads)
    assert "Join" in plan(wide) and wide.where("k < 1 AND chrom IS NOT NULL").isEmpty()


@pytest.mark.parametrize("empirical", [False, True])
def test_rates_are_broadcast(spark, no_broadcast, empirical):
    reads = tags(spark).where("chromEnd > chromStart + 3 and name like 't%'")
    muts = reads.withColumn("chromEnd", F.col("chromStart") + 3).withColumn("chromStart", F.col("chromStart") + 2)
    found = cims.mutation_sites(reads, muts, empirical=empirical)
    assert "SortMergeJoin" not in plan(found) and found.agg(F.sum("m")).first()[0] == muts.count()


def test_drawn_offsets_follow_their_counts(spark):
    reads = spark.createDataFrame([("c", 1_000, 1_100, "t", 1.0, "+")], BED)
    counted = spark.createDataFrame([(3, 6_000), (20, 1), (40, 3_000)], "offset long, n long")
    each = counted.select("offset", F.explode(F.sequence(F.lit(1), F.col("n")))).select("offset")
    one, other = (mutations.simulate_sites(reads, 3_000, 1, offsets=o).groupBy("chromStart").count() for o in (counted, each))
    seen = {r["chromStart"]: r["count"] for r in one.collect()}
    assert seen == {r["chromStart"]: r["count"] for r in other.collect()} and 1.8 < seen[1_003] / seen[1_040] < 2.2


def test_depths_see_pile_ups_by_position(spark):
    deep = spark.range(20_000).selectExpr("'c' AS chrom", "100L AS chromStart", "130L AS chromEnd", "'+' AS strand")
    site = spark.createDataFrame([("c", 129, 130, "s", 0.0, "+")], BED)
    assert ranks.base_depths(site, deep, stranded=True).first()["n"] == 20_000


def test_lengths_are_broadcast(spark, no_broadcast):
    rows = tags(spark)
    lengths = rows.groupBy("chrom").agg(F.max("chromEnd").alias("length"))
    assert "SortMergeJoin" not in plan(geometry.clamp(rows, lengths))
    met = plan(coverage.hopping_windows(rows, lengths, stranded=True, nonzero=True))
    assert "[length" not in met or "BroadcastHashJoin [chrom" in met


def test_alleles_take_one_group(spark, no_broadcast):
    rng = random.Random(3)
    rows = [("c", s := rng.randrange(300), s + 1, f"m{i}", 1.0, rng.choice("+-"), "A", rng.choice(">>-"), rng.choice("CGTN")) for i in range(400)]
    muts, reads = spark.createDataFrame(rows, BED + ", refBase string, mtype string, altBase string"), tags(spark, reach=300)
    found, subs = alleles.site_alleles(reads, muts), muts.where("mtype = '>'")
    assert "Join" not in plan(found)
    want = mutations.allele_counts(mutations.depth_at(site_counts(subs), reads).withColumn("refBase", F.lit("A")), subs)
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


@pytest.mark.parametrize("error", [None, 0.02])
def test_mixtures_of_many_places_equal_one_by_one(error):
    rng = random.Random(8)
    words = ["".join(rng.choice("ACGT") for _ in range(3)) for _ in range(300)]
    names = [sorted(set(rng.choices(words, k=rng.randrange(1, 30)))) for _ in range(200)] + [["C", "A"], ["A", "C"]]
    copies = [[float(rng.choice([1, 1, 2, 50, 400])) for _ in row] for row in names]
    for one, many in zip([em.barcode_mixture(n, c, error) for n, c in zip(names, copies, strict=True)], em.barcode_mixtures(names, copies, error), strict=True):
        for key, want in one.items():
            assert np.allclose(many[key], want, rtol=1e-9, atol=1e-12), key


def test_error_rate_groups_places_once(spark, monkeypatch):
    """The table that the rounds read has a row for each place, so none of them shuffles it."""
    kept = []
    monkeypatch.setattr(collapse, "saved", lambda df: kept.append(df) or df)
    monkeypatch.setattr(collapse, "drop_saved", lambda df: None)
    reads = spark.createDataFrame([("c", 5, 30, f"t{i}", 1.0, "+", b) for i, b in enumerate(["ACG"] * 9 + ["ACT", "GGG"])], BED + ", barcode string")
    assert 0 < collapse.global_error_rate(reads, least=3) < 0.1
    assert len(kept) == 1 and kept[0].count() == 1 and "Join" not in plan(kept[0])


@pytest.mark.parametrize("stranded", [False, True])
def test_flags_need_no_join_by_name(spark, no_broadcast, stranded):
    """Short, empty and long intervals; only long ones are joined by pairs."""
    rng = random.Random(6)
    sets = {k: spark.createDataFrame([("c", s := rng.randrange(9_000), s + rng.choice([1, 9, 60, 700]), k, 0.0, rng.choice("+-")) for _ in range(40)], BED) for k in ("genic", "exon", "cds")}
    short = [("c", s := rng.randrange(9_000), s + rng.randrange(90), f"t{i}", 1.0, rng.choice("+-")) for i in range(400)] + [(None, 1, 9, "none", 1.0, "+"), ("x", 1, 9, "away", 1.0, "+")]
    for rows in (short, [*short, ("c", 100, 8_000, "long", 1.0, "+")]):
        found = annotate.region_flags(spark.createDataFrame(rows, BED), sets, stranded=stranded)
        assert ("name" in "".join(x for x in plan(found).splitlines() if "Exchange hashpartitioning(name" in x)) == (len(rows) > len(short))
        got = {r["name"]: tuple(r[k] for k in sets) for r in found.collect()}
        held = {k: df.collect() for k, df in sets.items()}
        for chrom, s, e, name, _, strand in rows:
            assert got[name] == tuple(any(x["chrom"] == chrom and (not stranded or x["strand"] == strand) and s < x["chromEnd"] and x["chromStart"] < e for x in held[k]) for k in sets), name
