import random

import numpy as np
import plain_valleys
import pytest

from locusloom.plans import peaks


def brute_peaks(start, end, height, depth):
    """Valley rules by full scans."""
    n, floor = len(height), 1 - depth
    if n == 1:
        return [start[0]]
    tops = [i for i in range(n) if (i == n - 1 or height[i] > height[i + 1]) and (i == 0 or height[i] >= height[i - 1])]
    lows = [i for i in range(n) if i not in tops and (i == n - 1 or height[i] < height[i + 1]) and (i == 0 or height[i] <= height[i - 1])]
    rank = lambda i: (height[i], end[i] - start[i])
    keep = []
    for t in tops:
        before = next((j for j in reversed(tops) if j < t and rank(j) > rank(t)), None)
        after = next((j for j in tops if j > t and rank(j) >= rank(t)), None)
        left = before is None or any(before < v < t and height[v] / height[t] <= floor for v in lows)
        right = after is None or any(t < v < after and height[v] / height[t] <= floor for v in lows)
        if left and right:
            keep.append(start[t])
    return keep


def block(rng, n, levels, at=0):
    """Steps of one unbroken stretch with heights that change from step to step."""
    width = [rng.randrange(1, 4) for _ in range(n)]
    start = at + np.cumsum([0, *width[:-1]])
    height = [float(rng.randrange(1, levels))]
    for _ in range(n - 1):
        height.append(float(rng.choice([h for h in range(1, levels) if h != height[-1]])))
    return start, start + np.array(width), np.array(height)


def test_whole_blocks_equal_full_scans():
    rng = random.Random(3)
    for _ in range(300):
        start, end, height = block(rng, rng.randrange(1, 25), 8)
        found = plain_valleys.block_peaks(start, end, height, 0.6)
        assert [p["start"] for p in found] == brute_peaks(start.tolist(), end.tolist(), height.tolist(), 0.6)
        assert all(p["left"] <= p["start"] and p["right"] >= p["end"] for p in found)


@pytest.mark.parametrize("width, levels", [(7, 8), (16, 30), (64, 4), (1 << 17, 8)])
def test_bins_equal_whole_blocks(spark, monkeypatch, width, levels):
    """Stretches over many bins, some of one step, with breaks within bins and at their edges."""
    monkeypatch.setattr(peaks, "VALLEY_BIN", width)
    rng, rows, want = random.Random(width), [], []
    for chrom in "cde":
        for strand in "+-":
            at = 0
            for _ in range(12):
                n = rng.choice([1, 2, 5, 20, 120])
                start, end, height = block(rng, n, levels, at)
                rows += [(chrom, strand, int(s), int(e), float(h)) for s, e, h in zip(start, end, height, strict=True)]
                for p in plain_valleys.block_peaks(start, end, height, 0.5):
                    want.append((chrom, strand, p["start"], p["end"], p["height"], p["left"], p["right"], p["half_left"], p["half_right"]))
                at = int(end[-1]) + rng.choice([1, 3, width])
    steps = spark.createDataFrame(rows, "chrom string, strand string, chromStart long, chromEnd long, score double").repartition(5)
    assert sorted(map(tuple, peaks.valley_peaks(steps, 0.5, 0.0).collect())) == sorted(want)


def test_one_long_stretch_is_many_bins(spark, monkeypatch):
    """A stretch of 100,000 steps: 25 bins, equal to one pass over all of it."""
    monkeypatch.setattr(peaks, "VALLEY_BIN", 8_000)
    start, end, height = block(random.Random(8), 100_000, 400)
    want = [(p["start"], p["end"], p["left"], p["right"], p["half_left"], p["half_right"]) for p in plain_valleys.block_peaks(start, end, height, 0.9)]
    import pandas as pd

    steps = spark.createDataFrame(pd.DataFrame(dict(chrom="c", chromStart=start, chromEnd=end, score=height)))
    found = peaks.valley_peaks(steps, 0.9, 0.0, stranded=False)
    assert sorted((r["chromStart"], r["chromEnd"], r["left"], r["right"], r["half_left"], r["half_right"]) for r in found.collect()) == want
    assert "CollectList" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_maxima_of_all_stretches_at_once():
    import pyarrow as pa

    table = pa.table(dict(chromStart=[9, 0, 2, 4, 11], chromEnd=[11, 2, 4, 6, 12], score=[3.0, 2.0, 2.0, 1.0, 5.0], before=[1.0] * 5, after=[7.0] * 5))
    parts, steps = peaks._stretches(table)
    assert [(p.start, p.stop) for p in parts] == [(0, 3), (3, 5)]
    assert steps["maxima"].tolist() == [False, True, False, False, False] and steps["start"].tolist() == [0, 2, 4, 9, 11]


def test_no_coverage(spark):
    assert peaks.valley_peaks(spark.createDataFrame([], "chrom string, strand string, chromStart long, chromEnd long, score double")).count() == 0
