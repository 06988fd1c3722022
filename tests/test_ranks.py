import random

import pytest
from pyspark.sql import functions as F

from locusloom.operators import overlap, ranks, scan

BED = "chrom string, chromStart long, chromEnd long, name string, score double, strand string"


def intervals(seed, n, reach=400, longest=60):
    rng = random.Random(seed)
    starts = [(rng.choice("cd"), rng.randrange(reach)) for _ in range(n)]
    return [(c, s, s + rng.randrange(longest) * rng.randrange(2), f"n{i}", 1.0, rng.choice("+-")) for i, (c, s) in enumerate(starts)]


@pytest.mark.parametrize("stranded, ext5, ext3", [(False, 0, 0), (True, 0, 0), (True, 3, 7)])
def test_ranks_equal_pairs(spark, monkeypatch, stranded, ext5, ext3):
    monkeypatch.setattr(scan, "BIN", 64)
    tags, regions = intervals(1, 600), intervals(2, 150) + [("e", 5, 9, "far", 0.0, "+"), (None, 5, 9, "null", 0.0, "+")]
    found = ranks.region_numbers(spark.createDataFrame(regions, BED), spark.createDataFrame([*tags, (None, 1, 99, "null", 0.0, "+")], BED), stranded, ext5, ext3)

    def meets(t, r):
        left, right = (ext5, ext3) if t[5] == "+" else (ext3, ext5)
        return t[0] == r[0] and (not stranded or t[5] == r[5]) and t[1] - left < r[2] and r[1] < t[2] + right

    assert {r["name"]: r["n"] for r in found.collect()} == {r[3]: sum(meets(t, r) for t in tags) for r in regions}


def test_spliced_tags_skip_what_their_introns_hold(spark):
    rng = random.Random(4)
    rows = [("c", s, s + 60, f"t{i}", 1.0, "+", [10, 5, 10], [0, rng.randrange(12, 40), 50]) for i, s in enumerate(rng.choices(range(300), k=100))]
    rows += [("c", s, s + 30, f"p{i}", 1.0, "+", None, None) for i, s in enumerate(range(0, 300, 7))]
    tags = spark.createDataFrame(rows, BED + ", blockSizes array<long>, blockStarts array<long>")
    regions = spark.createDataFrame(intervals(5, 100, longest=8), BED).withColumn("chrom", F.lit("c"))
    by_ranks = {r["name"]: r["n"] for r in ranks.region_numbers(regions, tags).collect()}
    by_pairs = {r["name"]: r["n"] for r in overlap.region_counts(regions, tags).collect()}
    assert by_ranks == by_pairs and any(by_ranks.values())


def test_pile_up_is_counted_by_position(spark):
    """Tags of one place reach the windows as two rows, and no join of tags with regions is planned."""
    tags = spark.range(50_000).selectExpr("'c' AS chrom", "100L AS chromStart", "130L AS chromEnd", "'+' AS strand")
    sites = spark.createDataFrame([("c", s, s + 1, "s", 0.0, "+") for s in (99, 100, 129, 130)], BED)
    counted = ranks.overlap_counts(sites, tags, stranded=True)
    assert {r["chromStart"]: r["n"] for r in counted.collect()} == {99: 0, 100: 50_000, 129: 50_000, 130: 0}


def test_no_tags_and_no_regions(spark):
    some, none = spark.createDataFrame(intervals(6, 20), BED), spark.createDataFrame([], BED)
    assert {r["n"] for r in ranks.region_numbers(some, none).collect()} == {0}
    assert ranks.region_numbers(none, some).count() == 0


def test_depths_over_many_bins_need_no_lambda(spark):
    """Lambdas are interpreted, so a tag that stays in its bin has none; longer ones go up again in each bin."""
    size = 1 << 14
    tags = spark.createDataFrame([("c", 5, 3 * size, "t", 0.0, "+"), ("c", size - 1, size + 1, "t", 0.0, "+"), ("c", size, size + 2, "t", 0.0, "-"), ("c", 7, 7, "t", 0.0, "+")], BED)
    sites = spark.createDataFrame([("c", s, s + 1, "s", 0.0, "+") for s in (4, 5, 7, size - 1, size, size + 1, 2 * size, 3 * size - 1, 3 * size)], BED)
    deep = ranks.base_depths(sites, tags, stranded=True)
    assert {r["chromStart"]: r["n"] for r in deep.collect()} == {4: 0, 5: 1, 7: 1, size - 1: 2, size: 2, size + 1: 1, 2 * size: 1, 3 * size - 1: 1, 3 * size: 0}
    assert "lambda" not in deep._jdf.queryExecution().optimizedPlan().toString()
