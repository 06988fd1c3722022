import random

import corpus_pipeline
import numpy as np
from locusloom.llm import shingle_dedup
from locusloom.llm.simhash import fingerprint_of
from pyspark.sql import functions as F


def jaccard(a, b):
    shingles = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    return len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1])


def planted():
    rng, rows, near, far = random.Random(5), [], [], []
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(150, 500))]
        copy = list(words)
        for _ in range(rng.randrange(1, 8) * len(words) // 250 + 1):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
        value = jaccard(" ".join(words), " ".join(copy))
        rows += [(f"a{k:03}", " ".join(words), k), (f"b{k:03}", " ".join(copy), k)]
        (near if value >= 0.8 else far).append(f"b{k:03}")
    return rows, near, far


def test_stage_drops_every_planted_copy(spark):
    rows, near, far = planted()
    wide = [r for r in rows if r[0] in near]
    originals = {r[2]: r[1] for r in rows if r[0].startswith("a")}
    # Most planted copies are beyond the reach of the fingerprints of op3.
    assert sum(bin(fingerprint_of(r[1]) ^ fingerprint_of(originals[r[2]])).count("1") > 3 for r in wide) > len(wide) / 2
    assert len(near) > 30 and len(far) > 10
    far = [r[0] for r in rows if r[0] in far and bin(fingerprint_of(r[1]) ^ fingerprint_of(originals[r[2]])).count("1") > 3]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n long")
    out = corpus_pipeline.keep_one_near_copy(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted([f"a{k:03}" for k in range(120)] + far)


def test_leaders_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(f"d{k:02}", " ".join(w if rng.random() > 0.001 or i % 60 else f"y{k}" for i, w in enumerate(words)) + f" end {k}") for k in range(40)]
    rows += [("e1", None), ("e2", ""), ("f1", "two words"), ("f2", "Two  words"), (None, " ".join(words)), (None, "quite another text of six words")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    want = sorted(str(r.doc_id) for r in shingle_dedup.drop_shingle_copies(docs).collect())
    assert want == ["None", "d00", "e1", "e2", "f1"]
    monkeypatch.setattr(shingle_dedup, "CROWD", 1)
    assert sorted(str(r.doc_id) for r in shingle_dedup.drop_shingle_copies(docs).collect()) == want
    assert shingle_dedup.drop_shingle_copies(docs.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for similarity in (0.5, 0.8, 0.95):
        shared = rng.integers(0, 1 << 63, int(2000 * similarity), np.uint64)
        own = (2000 - len(shared)) // 2
        a, b = (shingle_dedup.min_hashes(np.concatenate([shared, rng.integers(0, 1 << 63, own, np.uint64)])) for _ in "ab")
        nibbles = [[int(n) >> 4 * i & 15 for n in shingle_dedup.sketch(x).view(np.uint64) for i in range(16)] for x in (a, b)]
        assert nibbles[0] == [int(v) & 15 for v in a]
        assert abs(np.mean(np.equal(*nibbles)) - (similarity + (1 - similarity) / 16)) < 0.12


def test_recall_at_the_similarity_and_few_pairs_in_a_hot_band(spark):
    """Pairs at exactly 0.8 nearly all pass bands and sketch; unlike texts of one group hardly any do."""
    rng = np.random.default_rng(9)
    marks = []
    for k in range(600):
        shared, own = rng.integers(0, 1 << 63, 400, np.uint64), rng.integers(0, 1 << 63, (2, 50), np.uint64)
        for side in range(2):
            least = shingle_dedup.min_hashes(np.concatenate([shared, own[side]]))
            marks.append((f"p{k}", side, shingle_dedup.band_keys(least).tolist(), shingle_dedup.sketch(least).tolist()))
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    for k in range(300):  # half of the base each: a similarity of a third to each other
        least = shingle_dedup.min_hashes(np.concatenate([rng.permutation(base)[:200], rng.integers(0, 1 << 63, 200, np.uint64)]))
        marks.append(("hot", k, shingle_dedup.band_keys(least).tolist(), shingle_dedup.sketch(least).tolist()))
    rows = spark.createDataFrame(marks, "pair string, side int, bands array<long>, sketch array<long>")
    a, b = (rows.select("pair", *[F.col(c).alias(f"{x}_{c}") for c in ("side", "bands", "sketch")]) for x in "ab")
    met = a.join(b, "pair").where("a_side < b_side").where(F.arrays_overlap("a_bands", "b_bands") & shingle_dedup._sketches_agree("a_sketch", "b_sketch", 0.8))
    counts = {r["hot"]: r["count"] for r in met.groupBy((F.col("pair") == "hot").alias("hot")).count().collect()}
    assert counts[False] >= 0.99 * 600 and counts.get(True, 0) <= 3


def test_both_kinds_of_links_are_one_graph(spark):
    """a and b are alike in words; c shares their long refrain and so their print, but few of its words."""
    refrain = " ".join(f"r{i}" for i in range(11)) + " "
    tails = [[f"{side}{i}" for i in range(60)] for side in "ac"]
    rows = [("a", tails[0]), ("b", [*tails[0][:-2], "y", "z"]), ("c", tails[1])]
    rows = [(name, refrain * 80 + " ".join(tail)) for name, tail in rows]
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 > 0.5 > jaccard(rows[0][1], rows[2][1])
    docs = spark.createDataFrame([*rows, ("d", "quite different text"), ("e", None), ("f", " ")], "doc_id string, text string")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(shingle_dedup.drop_shingle_copies(docs, distance=3)) == ["a", "d", "e"]
    assert ids(shingle_dedup.drop_shingle_copies(docs)) == ["a", "c", "d", "e", "f"]
