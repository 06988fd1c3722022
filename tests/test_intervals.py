"""Interval operators against brute force and hand-made edge cases."""

import random

import pytest

from locusloom.operators import cluster, coverage, geometry, overlap
from locusloom.operators.scan import numbered

BED = "chrom string, chromStart long, chromEnd long, name string, score double, strand string"


def bed(spark, rows):
    return spark.createDataFrame(rows, BED)


def drawn(n, seed, top=400_000, longest=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(top)
        rows.append((f"chr{rng.randrange(2)}", start, start + rng.choice([1, 5, longest]), f"x{i}", float(rng.randrange(9)), rng.choice("+-")))
    return rows


def meets(a, b):
    return a[0] == b[0] and a[1] < b[2] and b[1] < a[2]


@pytest.mark.parametrize("stranded", [False, True])
@pytest.mark.parametrize("longest", [300, 200_000])
def test_overlap_join_equals_nested_loop(spark, stranded, longest):
    a, b = drawn(150, 1), drawn(80, 2, longest=longest)
    found = overlap.overlap_join(bed(spark, a), bed(spark, b), stranded, width=128).select("name", "region_name").collect()
    want = [(x[3], y[3]) for x in a for y in b if meets(x, y) and (not stranded or x[5] == y[5])]
    assert sorted(map(tuple, found)) == sorted(want)


def test_overlap_filters_and_book_ends(spark):
    tags = bed(spark, [("c", 0, 10, "touch", 0.0, "+"), ("c", 0, 11, "in", 0.0, "+"), ("d", 0, 50, "elsewhere", 0.0, "+")])
    regions = bed(spark, [("c", 10, 20, "r", 0.0, "+")])
    assert [r.name for r in overlap.overlap_filter(tags, regions).collect()] == ["in"]
    assert {r.name for r in overlap.overlap_filter(tags, regions, keep=False).collect()} == {"touch", "elsewhere"}
    empty = regions.limit(0)
    assert overlap.overlap_filter(tags, empty).count() == 0
    assert overlap.overlap_filter(tags, empty, keep=False).count() == 3


def test_spliced_tag_with_region_in_intron(spark):
    tag = spark.createDataFrame([("c", 0, 100, "t", 0.0, "+", [10, 10], [0, 90])], BED + ", blockSizes array<long>, blockStarts array<long>")
    regions = bed(spark, [("c", 20, 40, "intron", 0.0, "+"), ("c", 5, 40, "exon", 0.0, "+")])
    rows = overlap.overlap_join(tag, regions).collect()
    assert [(r.region_name, r.overlap, r.fraction) for r in rows] == [("exon", 5, 0.25)]


def test_region_counts_keep_empty_regions(spark):
    tags, regions = bed(spark, [("c", 0, 10, "a", 2.0, "+"), ("c", 5, 8, "b", 4.0, "+")]), bed(spark, [("c", 0, 9, "r", 0.0, "+"), ("d", 0, 9, "none", 0.0, "+")])
    rows = {r.name: (r.n, r.total, r.mean) for r in overlap.region_counts(regions, tags).collect()}
    assert rows == {"r": (2, 6.0, 3.0), "none": (0, 0.0, 0.0)}


def test_region_peaks_widen_on_ties(spark):
    signal = bed(spark, [("c", 0, 5, "", 3.0, "+"), ("c", 5, 9, "", 7.0, "+"), ("c", 12, 15, "", 7.0, "+"), ("c", 15, 20, "", 4.0, "+")])
    region = bed(spark, [("c", 0, 30, "r", 0.0, "+"), ("d", 0, 30, "none", 0.0, "+")])
    rows = {r.name: r for r in overlap.region_peaks(region, signal).collect()}
    r = rows["r"]
    assert (r.peakScore, r.peakStart, r.peakEnd, r.halfPeakStart, r.halfPeakEnd) == (7.0, 5, 15, 5, 20)
    assert rows["none"].peakScore == -1e10 and rows["none"].peakStart is None


def brute_islands(rows, gap, strict, stranded):
    found, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        key = (r[0], r[5] if stranded else "")
        reach, n = last.get(key, (None, 0))
        near = reach is not None and (r[1] - reach < gap if strict else r[1] - reach <= gap)
        n = n if near else n + 1
        last[key] = (max(reach, r[2]) if near else r[2], n)
        found.setdefault((*key, n), []).append(r)
    return sorted((k[0], min(x[1] for x in v), max(x[2] for x in v), float(len(v))) for k, v in found.items())


@pytest.mark.parametrize("gap", [-1, 0, 40])
def test_cluster_equals_scan(spark, gap):
    rows = drawn(400, 3, top=300_000)
    found = cluster.cluster(bed(spark, rows), gap, stranded=True).select("chrom", "chromStart", "chromEnd", "score").collect()
    assert sorted(map(tuple, found)) == brute_islands(rows, gap, False, True)


def test_cluster_gap_rules(spark):
    rows = [("c", 0, 10, "a", 1.0, "+"), ("c", 10, 20, "b", 2.0, "+"), ("c", 21, 30, "c", 3.0, "+")]
    df = bed(spark, rows)
    assert [(r.chromStart, r.chromEnd, r.name) for r in cluster.cluster(df, 0, stranded=True).orderBy("chromStart").collect()] == [(0, 20, "c_f_c0"), (21, 30, "c_f_c1")]
    # Best per island joins below the gap, one less.
    assert {r.name for r in cluster.best_per_island(df, "maxScore", 0).collect()} == {"a", "b", "c"}
    assert {r.name for r in cluster.best_per_island(df, "maxScore", 1).collect()} == {"b", "c"}
    assert {r.name for r in cluster.best_per_island(df, "singleton", 1).collect()} == {"c"}
    with pytest.raises(ValueError):
        cluster.best_per_island(df, max_gap=-1)


def test_collapse_by_barcode(spark):
    rows = [("c", 0, 10, "a#AC", 1.0, "+"), ("c", 0, 10, "b#AC", 1.0, "+"), ("c", 0, 10, "c#GT", 1.0, "+"), ("c", 0, 10, "d#GN", 1.0, "+")]
    found = cluster.collapse_intervals(bed(spark, rows), 1, by_barcode=True).collect()
    assert {(r.name, r.score) for r in found} == {("a#AC", 2.0), ("c#GT", 1.0)}


def test_coverage_equals_counting(spark):
    rows = drawn(200, 5, top=200_000)
    found = coverage.exact_coverage(bed(spark, rows), stranded=True).collect()
    depth = {}
    for r in rows:
        for p in range(r[1], r[2]):
            depth[(r[0], r[5], p)] = depth.get((r[0], r[5], p), 0) + 1
    got = {(r.chrom, r.strand, p): r.score for r in found for p in range(r.chromStart, r.chromEnd)}
    assert got == {k: float(v) for k, v in depth.items()}
    # Neighbouring stretches differ, so none could be merged.
    ends = {(r.chrom, r.strand, r.chromEnd): r.score for r in found}
    assert all(ends.get((r.chrom, r.strand, r.chromStart)) != r.score for r in found)


def test_hopping_windows_partition_the_axis(spark):
    tags = bed(spark, [("c", 5, 25, "a", 2.0, "+"), ("c", 39, 41, "b", 4.0, "-")])
    lengths = spark.createDataFrame([("c", 50), ("short", 5), ("none", 30)], "chrom string, length long")
    rows = coverage.hopping_windows(tags, lengths, 10, 10).collect()
    assert {(r.chrom, r.chromStart): r.n for r in rows} == {("c", 0): 1, ("c", 10): 1, ("c", 20): 1, ("c", 30): 1, ("c", 40): 1, ("none", 0): 0, ("none", 10): 0, ("none", 20): 0}


def test_geometry_by_strand(spark):
    df = bed(spark, [("c", 100, 110, "p", 0.0, "+"), ("c", 100, 110, "m", 0.0, "-")])
    of = lambda d: {r.name: (r.chromStart, r.chromEnd) for r in d.collect()}
    assert of(geometry.grow(df, 1, 2)) == {"p": (99, 112), "m": (98, 111)}
    assert of(geometry.extend(df, 1, 2)) == {"p": (101, 112), "m": (98, 109)}
    assert of(geometry.flank_up(df, -1, -1)) == {"p": (99, 100), "m": (110, 111)}
    assert of(geometry.flank_down(df, 1, 5)) == {"p": (110, 115), "m": (95, 100)}
    assert of(geometry.grow(df, -6, -6)) == {}
    lengths = spark.createDataFrame([("c", 105)], "chrom string, length long")
    assert of(geometry.clamp(df, lengths))["p"] == (100, 105)
    assert of(geometry.clamp(geometry.grow(df, 200, 0), lengths))["p"] == (0, 105)
    inside = geometry.random_subinterval(df, 4)
    assert all(r.chromEnd - r.chromStart == 4 and 100 <= r.chromStart and r.chromEnd <= 110 for r in inside.collect())
    with pytest.raises(ValueError):
        geometry.coloured(df, "no such colour")


def test_numbers_follow_the_genome(spark):
    rows = drawn(300, 9, top=900_000)
    found = numbered(bed(spark, rows)).orderBy("nth").collect()
    assert [r.nth for r in found] == list(range(1, 301))
    assert [(r.chrom, r.chromStart) for r in found] == sorted((r[0], r[1]) for r in rows)


def test_overlap_join_has_no_cartesian_product(spark):
    a, b = bed(spark, drawn(50, 1)), bed(spark, drawn(50, 2))
    plan = overlap.overlap_join(a, b, width=128)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
