import random

import pytest

from locusloom.operators import coverage

BED = "chrom string, chromStart long, chromEnd long, name string, score double, strand string, blockSizes array<long>, blockStarts array<long>"


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s, size = rng.randrange(300), rng.randrange(1, 80)
        cuts = [None, None] if size < 40 or rng.random() < 0.4 else [[3, 5, 4], [0, rng.randrange(8, 20), size - 4]]
        rows.append((rng.choice("cdx"), s, s + size, f"t{i}", rng.choice([1.0, 0.1, 2.5, 1e6]), rng.choice("+-"), *cuts))
    return rows


@pytest.mark.parametrize("width, step, stranded, nonzero", [(10, 10, False, False), (25, 4, True, False), (100, 7, False, True), (3, 1, True, True)])
def test_windows_equal_a_count_of_each(spark, monkeypatch, width, step, stranded, nonzero):
    monkeypatch.setattr(coverage, "BIN", 16)
    tags, lengths = made(width, 150), {"c": 320, "d": 200, "e": 50, "f": 2}
    found = coverage.hopping_windows(spark.createDataFrame(tags, BED), spark.createDataFrame(list(lengths.items()), "chrom string, length long"), width, step, stranded, nonzero)
    want = {}
    for chrom, length in lengths.items():
        for strand in "+-" if stranded else ("",):
            for i in range((length - width) // step + 1 if length >= width else 0):
                s, e = i * step, i * step + width
                hits = []
                for t in tags:
                    if t[0] != chrom or (stranded and t[5] != strand) or not (t[1] < e and s < t[2]):
                        continue
                    ends = [(t[1] + at, t[1] + at + n) for n, at in zip(*t[6:], strict=True)] if t[6] else [t[1:3]]
                    if not any(a[1] <= s and e <= b[0] for a, b in zip(ends, ends[1:])):
                        hits.append(t[4])
                if hits or not nonzero:
                    want[chrom, strand, s, e, f"w{i}"] = (len(hits), pytest.approx(sum(hits)))
    got = {(r["chrom"], r["strand"] if stranded else "", r["chromStart"], r["chromEnd"], r["name"]): (r["n"], r["total"]) for r in found.collect()}
    assert got == want
    assert all(abs(r["mean"] * max(1, r["n"]) - r["total"]) < 1e-6 for r in found.collect())


def test_wide_windows_make_no_row_for_each_tag_and_window(spark):
    """20,000 tags in up to 10,000 windows each: some 10,000 windows come out."""
    tags = spark.range(20_000).selectExpr("'c' AS chrom", "10000 + id % 50 AS chromStart", "10060 + id % 50 AS chromEnd", "1.0D AS score")
    rows = coverage.hopping_windows(tags, spark.createDataFrame([("c", 25_000)], "chrom string, length long"), width=10_000, step=1, nonzero=True)
    assert rows.agg({"n": "max"}).head()[0] == 20_000 and 10_000 < rows.count() < 10_200
