import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hard_rows import HARD
from locusloom.llm import common, embedding_dedup, simhash
from locusloom.llm.components import components


def brute_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 540)]
    want = brute_components({n for a, b in links if a != b for n in (a, b)}, links)
    got = components(spark.createDataFrame(links + [(None, 3), (7, 7)], "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_no_links_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def check_groups(df, rows):
    got = simhash.simhash_groups(df).collect()
    prints = [(r[0], brute_print(r[1])) for r in rows]
    assert sorted((str(r.doc_id), r.print & (2**64 - 1)) for r in got) == sorted((str(i), p) for i, p in prints)
    distinct = sorted({p for _, p in prints})
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if bin(a ^ b).count("1") <= 3]
    of = brute_components(distinct, links)
    lowest = defaultdict(list)
    for i, p in prints:
        lowest[of[p]].append(i)
    want = {p: min((i for i in lowest[of[p]] if i is not None), default=None) for p in distinct}
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(want[p])) for i, p in prints)


def test_simhash_of_documents(documents):
    check_groups(documents, [tuple(r) for r in documents.collect()])


def test_simhash_of_hard_rows(hard):
    check_groups(hard, HARD)
    assert simhash.simhash_groups(hard.limit(0)).count() == 0
    kept = simhash.drop_near_copies(hard)
    assert kept.columns == hard.columns
    # 1 and 5 are equal, 2 to 4 and a nameless row have no words, 7 comes twice with one identifier.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in (1, 2, 6, 7, 8, 9, 10, None))


def test_one_row_of_each_group_stays_whatever_its_identifiers(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    near = lambda k: " ".join([*words, f"end{k}"])
    rows = [(5, near(1)), (5, near(2)), (5, near(1)), (7, near(3)), (None, near(4)), (5, "quite another text"), (None, "nameless"), (None, "nameless")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__n", F.lit(1))
    for most in (1000, 0):  # broadcast, and joined
        monkeypatch.setattr(common, "MOST_SENT", most)
        got = sorted((str(r.doc_id), r.text[:8]) for r in simhash.drop_near_copies(df).collect())
        assert got == [("5", "quite an"), ("5", "w0 w1 w2"), ("None", "nameless")]


def test_fingerprint_equals_spark_hash(spark):
    row = spark.sql("select xxhash64('a b c') as h").first()
    assert simhash.fingerprint_of("A b C") == row.h & (2**64 - 1)


def test_every_close_pair_shares_a_mask():
    rng = random.Random(1)
    masks = simhash.block_masks(3, 5)
    assert len(masks) == 10
    for _ in range(2000):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(flip & (m & (2**64 - 1)) == 0 for m in masks)


def test_links_in_a_dense_bucket(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(120)})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()}
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want


def planted(seed=5, dim=32):
    """Vectors with pairs at known cosines, a dense cluster, copies, and unusable ones."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [unit(rng.standard_normal(dim)) * rng.uniform(0.5, 3) for _ in range(300)]
    for cos in (0.88, 0.905, 0.95, 0.99) * 10:
        x = unit(rng.standard_normal(dim))
        z = rng.standard_normal(dim)
        z = unit(z - (z @ x) * x)
        rows += [x, cos * x + np.sqrt(1 - cos * cos) * z]
    centre = unit(rng.standard_normal(dim))
    rows += [unit(centre + 0.02 * rng.standard_normal(dim)) for _ in range(80)]
    rows += [unit(centre + 0.06 * rng.standard_normal(dim)) for _ in range(120)]  # some within the threshold, some beyond
    rows += [rows[0]] * 30
    return [[float(np.float32(x)) for x in r] for r in rows]


def check_links(got, vectors, share=0.995):
    """``got`` by position against all pairs; ids are positions."""
    x = np.array(vectors)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    missed = sum(abs(got[i].n_links - int(near[i].sum())) for i in range(len(vectors)))
    assert missed <= (1 - share) * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(len(vectors)))
    want = brute_components(range(len(vectors)), zip(*np.nonzero(near), strict=True))
    assert sum(got[i].component_id != want[i] for i in range(len(vectors))) <= 0.01 * len(vectors)


def groups_of(spark, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    return {r.vec_id: r for r in embedding_dedup.embedding_groups(df).collect()}


@pytest.mark.parametrize("crowd", [16, 1 << 30])
def test_embedding_links_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(embedding_dedup, "CELL", 32)  # cuts crowded lines into chunks
    monkeypatch.setattr(embedding_dedup, "CROWD", crowd)  # with balls, and without
    vectors = planted()
    bad = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] + [1.0] * 31, [float("inf")] * 32, [1.0] * 3]
    rows = [(i, v) for i, v in enumerate([*vectors, *bad])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit(1)).withColumn("mix", F.lit(2))
    got = {r.vec_id: r for r in embedding_dedup.embedding_groups(df).collect()}
    check_links(got, vectors)
    for i in range(len(vectors), len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_a_dense_group_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CROWD", 16)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(24)
    vectors = [(centre + 0.05 * rng.standard_normal(24)).tolist() for _ in range(300)] + rng.standard_normal((40, 24)).tolist()
    seen = []
    inner = embedding_dedup._collisions

    def counted(entries, plan):
        pairs = inner(entries, plan)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(embedding_dedup, "_collisions", counted)
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    check_links(groups_of(spark, vectors), vectors, 1.0)
    assert seen[0] < 100  # of 44,850 pairs inside the group


@pytest.mark.parametrize("dim", [1, 2, 3, 200])
def test_links_in_few_and_many_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((60, dim))
    vectors = np.concatenate([base, base + 0.3 * rng.standard_normal((60, dim)), 3 * base[:10]])
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    check_links(groups_of(spark, vectors), vectors, 0.99)


def test_rows_that_repeat_an_identifier(spark):
    x, y, far = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, x), (3, far), (900, y), (5, [0.0, 2.0, 0.0]), (5, [0.0, 2.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_groups(df).collect())
    assert got == [(3, 0, 3), (3, 1, 3), (5, 1, 5), (5, 1, 5), (900, 1, 3)]


def test_scaled_copies_are_one_node(spark):
    rows = [(i, [2.0**i, 3 * 2.0**i]) for i in range(8)]
    got = embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(7, 0)}


def test_embeddings_of_an_empty_table(spark):
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    some = spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_groups(some).collect()} == {(None, 1, 3), (3, 1, 3)}


def test_recall_at_the_threshold_in_each_dimension():
    for dim in (2, 16, 64, 300):
        families, least = embedding_dedup.calibrate(dim, 0.9, 128, 0.997)
        rng = np.random.default_rng(dim + 77)
        one, other = rng.standard_normal((2, 1500, dim))
        one /= np.linalg.norm(one, axis=1, keepdims=True)
        other -= (other * one).sum(1, keepdims=True) * one
        other /= np.linalg.norm(other, axis=1, keepdims=True)
        two = 0.9 * one + np.sqrt(1 - 0.81) * other
        counts = np.zeros(len(one), int)
        for family in range(families):
            (a, va), (b, vb) = (embedding_dedup.tails(x, 128, family) for x in (one, two))
            counts += ((a[:, :, None] == b[:, None, :]) & (np.abs(va[:, :, None] - vb[:, None, :]) <= embedding_dedup.WINDOW)).any(2).sum(1)
        assert least >= 2 and (counts >= least).mean() >= 0.99


def test_recall_out_of_reach_raises(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MOST_FAMILIES", 1)
    with pytest.raises(ValueError):
        embedding_dedup.calibrate(64, 0.9, 4096, 0.999)
