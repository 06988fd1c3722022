import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.llm import vector_codes
from locusloom.llm.queries import oracle_sql, op12_vector_codes
from locusloom.llm.vector_codes import assign, compress_vectors, grouped

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, entries=256, parts=4, rounds=4):
    """Every distance of every round, in integers of any size."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=1) // parts)
    cut = lambda v, p: tuple((v + [0] * (width * parts))[p * width : (p + 1) * width])
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [*cut(r[1], 0), *cut(r[1], 1), *cut(r[1], 2), *cut(r[1], 3)]))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(p, cut(v, p))[1], []).append(cut(v, p))
            for e, xs in members.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, [nearest(p, cut(v, p)) for p in range(parts)], label) for i, v, label in kept]
    totals = {}
    for _, near, label in found:
        totals[label] = totals.get(label, 0) + sum(d for d, _ in near)
    return sorted(((i, "".join(f"{c:02x}" for _, c in near), sum(d for d, _ in near), totals[label], digest) for i, near, label in found), key=str)


def made(seed, n=400, dims=8):
    rng = np.random.default_rng(seed)
    points = rng.normal(0, 0.2, (n, dims)).round(2)
    rows = [(int(i), [float(x) for x in v], int(rng.integers(3))) for i, v in enumerate(points)]
    hard = [(None, rows[5][1], None), (7, rows[8][1], 1), (7, rows[7][1], 1), (900, None, 1), (901, [None] * dims, 1), (902, [float("nan")] * dims, 1), (903, [float("inf")] * dims, None)]
    return rows + [(1000 + i, rows[3][1], None) for i in range(200)] + hard


def of_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in op12_vector_codes(spark, str(tmp_path)).collect()), key=str)


def test_query_equals_plain_rounds(spark, tmp_path):
    rows = made(1)
    assert of_query(spark, rows, tmp_path) == by_hand(rows)


def test_few_ragged_and_no_rows(spark, tmp_path):
    assert of_query(spark, [], tmp_path) == []
    rows = [(3, [0.5, -0.25, 0.125], None), (1, [], 2), (2, [0.1] * 6, 2), (4, [-0.0005], None)]
    assert of_query(spark, rows, tmp_path) == by_hand(rows)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    expected = con.execute(oracle_sql()["op12_vector_codes"]).fetchall()
    found = op12_vector_codes(spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


@pytest.mark.parametrize("seed", range(3))
def test_bounds_skip_groups_and_change_nothing(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3000, (40, 16))
    x = (centres[rng.integers(40, size=3000)] + rng.normal(0, 100, (3000, 16))).astype(np.int64)
    entries = x[:256].copy()
    entries[17] = entries[4]
    group = grouped(entries)
    code, error, bound, full = assign(x, entries, group, None, None, None)
    for _ in range(3):
        all_pairs = ((x[:, None] - entries) ** 2).sum(2)
        assert (code == all_pairs.argmin(1)).all() and (error == all_pairs.min(1)).all()
        others = np.where(np.arange(256) == code[:, None], np.inf, np.sqrt(all_pairs))
        for g in range(group.max() + 1):
            assert (bound[:, g] <= others[:, group == g].min(1, initial=np.inf) + 1e-6).all()
        moved = entries + rng.integers(-20, 21, entries.shape)
        drift = np.array([np.sqrt(((moved - entries)[group == g] ** 2).sum(1)).max(initial=0) for g in range(group.max() + 1)]) * (1 + 1e-9)
        entries = moved
        code, error, bound, some = assign(x, entries, group, code, bound, drift)
        assert some < 0.5 * full


def test_columns_are_carried_and_totals_salted(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MOST_SENT", 1)
    rows = spark.createDataFrame([(1, [0.5] * 4, 7), (2, [0.25] * 4, None), (3, [0.75] * 4, None), (4, [0.1] * 4, 7)], SCHEMA).withColumns({"codes": F.lit("c"), "vec": F.lit(1), "error": F.lit(2)})
    found = compress_vectors(rows, entries=1)
    assert len(found.scanned) == 5 and {r["row"]["codes"] for r in found.rows.collect()} == {"c"}
    summed = vector_codes.with_totals(found.rows, F.col("row.label"), F.col("error"), "total").collect()
    for label in (7, None):
        mine = [r for r in summed if r["row"]["label"] == label]
        assert len(mine) == 2 and {r["total"] for r in mine} == {sum(r["error"] for r in mine)}
