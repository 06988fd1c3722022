import random

import pytest

from locusloom.operators import scan
from locusloom.operators.tiles import tiled
from locusloom.plans.annotate import region_flags

BED = "chrom string, chromStart long, chromEnd long, name string, score double, strand string"


def made(seed, n, reach=500, longest=80):
    rng = random.Random(seed)
    return [(rng.choice("cd"), s, s + rng.randrange(longest), f"n{i}", 1.0, rng.choice("+-")) for i, s in enumerate(rng.choices(range(reach), k=n))]


@pytest.mark.parametrize("stranded", [False, True])
def test_tiles_equal_a_count_of_every_base(spark, monkeypatch, stranded):
    monkeypatch.setattr(scan, "BIN", 64)
    rows = {"a": made(1, 60), "b": made(2, 20), "c": made(3, 5) + [("e", 3, 9, "x", 0.0, "+"), (None, 1, 5, "x", 0.0, "+")]}
    want = {}
    for i, own in enumerate(rows.values()):
        for chrom, s, e, _, _, strand in own:
            for at in range(s, e) if chrom else ():
                key = (chrom, strand if stranded else "", at)
                want[key] = want.get(key, 0) | 1 << i
    found, last = {}, {}
    for r in sorted(tiled({k: spark.createDataFrame(v, BED) for k, v in rows.items()}, stranded).collect(), key=lambda r: r["chromStart"]):
        place = (r["chrom"], r["strand"] if stranded else "")
        assert r["chromStart"] < r["chromEnd"] and last.get(place, 0) <= r["chromStart"]
        last[place] = r["chromEnd"]
        found |= {(*place, at): r["mask"] for at in range(r["chromStart"], r["chromEnd"])}
    assert found == want


@pytest.mark.parametrize("stranded", [False, True])
def test_flags_equal_pairs_with_sets(spark, stranded):
    tags, sets = made(4, 200, longest=30), {"genic": made(5, 30), "exon": made(6, 30, longest=9), "cds": []}
    rng = random.Random(7)
    spliced = [(*t, [3, 4], [0, t[2] - t[1] - 4]) if t[2] - t[1] > 12 and rng.random() < 0.5 else (*t, None, None) for t in tags if t[2] > t[1]]
    frame = spark.createDataFrame(spliced, BED + ", blockSizes array<long>, blockStarts array<long>")
    flags = {r["name"]: (r["genic"], r["exon"], r["cds"]) for r in region_flags(frame, {k: spark.createDataFrame(v, BED) for k, v in sets.items()}, stranded=stranded).collect()}

    def meets(t, r):
        blocks = [(t[1] + at, t[1] + at + n) for n, at in zip(*t[6:], strict=True)] if t[6] else [t[1:3]]
        return t[0] == r[0] and (not stranded or t[5] == r[5]) and r[1] < r[2] and any(s < r[2] and r[1] < e for s, e in blocks)

    assert flags == {t[3]: tuple(any(meets(t, r) for r in rows) for rows in sets.values()) for t in spliced}


def test_a_pile_of_genes_is_one_segment(spark):
    genes = spark.range(20_000).selectExpr("'c' AS chrom", "10L AS chromStart", "500L AS chromEnd", "'+' AS strand")
    assert [tuple(r) for r in tiled({"genic": genes, "cds": genes.limit(0)}).collect()] == [("c", 10, 500, 1)]


def test_too_many_sets(spark):
    with pytest.raises(ValueError, match="63"):
        tiled({str(i): None for i in range(64)})
