"""Barcode mixtures of whole tables against plain loops."""

import math
import random

import numpy as np
import pytest

from locusloom.functions import em
from locusloom.operators import collapse
from locusloom.plans import catalogue
from test_catalogue import SF


def plain_mixture(counts, error=None):
    """Expectation maximisation by loops over every pair of barcodes."""
    names = sorted(counts)
    total, length = sum(counts.values()), len(names[0])
    if len(names) == 1:
        return {names[0]: (total, 100.0)}, 0.0
    e = em.HIGHEST_ERROR if error is None else error
    alpha = {b: counts[b] / total for b in names}
    apart = {(i, k): sum(x != y for x, y in zip(i, k, strict=True)) for i in names for k in names}
    for _ in range(em.ROUNDS):
        post = {}
        for i in names:
            chances = {k: e ** apart[i, k] * (1 - e) ** (length - apart[i, k]) * alpha[k] for k in names}
            post |= {(i, k): chances[k] / sum(chances.values()) for k in names}
        new = {k: sum(post[i, k] * counts[i] for i in names) / total for k in names}
        if error is None:
            wrong = sum(apart[p] * post[p] * counts[p[0]] for p in post)
            e = min(max(wrong / total / length, em.LOWEST_ERROR), em.HIGHEST_ERROR)
        moved = math.sqrt(sum((new[k] - alpha[k]) ** 2 for k in names) / len(names))
        alpha = new
        if moved < em.TOLERANCE:
            break
    sure = {k: -10 * sum(counts[i] * math.log10(1 - (1 - 1e-16 if post[i, k] == 1 else post[i, k])) for i in names) for k in names}
    return {k: (alpha[k] * total, sure[k]) for k in names}, e


@pytest.fixture(scope="module")
def places(spark):
    found = {}
    for r in catalogue._views(spark, SF)["tags"].collect():
        end = r.chromStart if r.strand == "+" else r.chromEnd - 1
        found.setdefault((r.chrom, r.strand, end), []).append(r)
    return found


def test_collapse_em_equals_plain_loops(spark, places):
    want = {}
    for place, rows in places.items():
        counts = {}
        for r in rows:
            counts[r.barcode] = counts.get(r.barcode, 0) + 1
        fitted, _ = plain_mixture(counts)
        best = min(fitted, key=lambda b: (-round(fitted[b][1], 6), -round(fitted[b][0], 6), b))
        for b, (n, sure) in fitted.items():
            sure = 100.0 if b == best and sure < 30 else sure
            if sure >= 30:
                longest = min((r for r in rows if r.barcode == b), key=lambda r: (r.chromStart - r.chromEnd, r.name))
                want[(*place, b)] = (longest.name, counts[b], n, sure)
    got = catalogue.queries()["collapse_em"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        name, seen, n, sure = want[r.chrom, r.strand, r.chromStart if r.strand == "+" else r.chromEnd - 1, r.barcode]
        assert (r.name, r.observed) == (name, seen)
        assert r.n == pytest.approx(n, rel=1e-6) and r.score == pytest.approx(sure, abs=0.006, rel=1e-6)


def test_global_error_equals_plain_loops(spark, places):
    covered = [rows for rows in places.values() if len(rows) >= 3]
    error = 0.02
    for _ in range(3):
        wrong = bases = 0.0
        for rows in covered:
            counts = {}
            for r in rows:
                counts[r.barcode] = counts.get(r.barcode, 0) + 1
            got = em.barcode_mixture(list(counts), [float(c) for c in counts.values()], error)
            fitted, _ = plain_mixture(counts, error)
            assert dict(zip(counts, got["n"], strict=True)) == pytest.approx({b: n for b, (n, _) in fitted.items()}, rel=1e-6)
            wrong, bases = wrong + got["mismatches"], bases + len(rows) * len(rows[0].barcode)
        error = max(wrong / bases, 1e-12)
    assert collapse.global_error_rate(catalogue._views(spark, SF)["tags"], least=3) == pytest.approx(error, rel=1e-6)


def many_barcodes(n, length=6):
    """Counts of so many barcodes: a third are true ones, the others misread from them."""
    rng = random.Random(n)
    seen = {"".join(rng.choice("ACGT") for _ in range(length)): rng.choice([1, 2, 5, 40, 300]) for _ in range(n // 3)}
    true = sorted(seen)
    while len(seen) < n:
        b = "".join(rng.choice("ACGT") if rng.random() < 0.3 else x for x in rng.choice(true))
        seen[b] = seen.get(b, 0) + rng.choice([1, 1, 2])
    return seen


def all_pairs(counts, error=None):
    """Expectation maximisation on whole matrices: n and reliability by barcode, error and mismatches."""
    names = sorted(counts)
    seen, length = np.array([counts[b] for b in names], float), len(names[0])
    letters = np.array([list(b) for b in names])
    apart = (letters[:, None, :] != letters[None, :, :]).sum(2)
    e = em.HIGHEST_ERROR if error is None else error
    alpha = seen / seen.sum()
    for _ in range(em.ROUNDS):
        joint = np.array([e**d * (1 - e) ** (length - d) for d in range(length + 1)])[apart] * alpha
        post = joint / joint.sum(1, keepdims=True)
        old, alpha = alpha, (post * seen[:, None]).sum(0) / seen.sum()
        mismatches = (apart * post * seen[:, None]).sum()
        if error is None:
            e = min(max(mismatches / seen.sum() / length, em.LOWEST_ERROR), em.HIGHEST_ERROR)
        if math.sqrt(((alpha - old) ** 2).mean()) < em.TOLERANCE:
            break
    sure = -10 * (seen[:, None] * np.log10(1 - np.where(post == 1, 1 - 1e-16, post))).sum(0)
    return dict(zip(names, zip(alpha * seen.sum(), sure, strict=True), strict=True)), e, mismatches


@pytest.mark.parametrize("error", [None, 0.02])
@pytest.mark.parametrize("n", [990, 1_100, 2_100])
def test_places_of_any_size_leave_no_pair_out(n, error):
    counts = many_barcodes(n)
    fitted, e, mismatches = all_pairs(counts, error)
    got = em.barcode_mixture(list(counts), [float(c) for c in counts.values()], error)
    assert np.allclose(got["n"], [fitted[b][0] for b in counts], rtol=1e-6, atol=1e-9)
    assert np.allclose(got["reliability"], [fitted[b][1] for b in counts], rtol=1e-6, atol=1e-9)
    assert (got["error"], got["mismatches"]) == pytest.approx((e, mismatches), rel=1e-9)


def test_blocks_of_pairs_change_nothing(monkeypatch):
    counts = many_barcodes(300, 5)
    names, copies = list(counts), [float(c) for c in counts.values()]
    whole = em.barcode_mixture(names, copies, 0.02)
    monkeypatch.setattr(em, "PAIRS", 2_500)
    parts = em.barcode_mixture(names, copies, 0.02)
    assert all(parts[k] == whole[k] for k in ("n", "reliability", "error", "total")) and parts["mismatches"] == pytest.approx(whole["mismatches"], rel=1e-12)
    monkeypatch.setattr(em, "PAIRS", 1)
    assert em.barcode_mixture(names, copies, 0.02)["reliability"] == whole["reliability"]


def test_pairs_are_left_out_on_request_only():
    counts = {"AAAA": 50.0, "AACC": 3.0, "CCCC": 20.0}
    near = em.barcode_mixture(list(counts), list(counts.values()), 0.02, reach=1)
    assert near["n"] == pytest.approx(list(counts.values())) and near["mismatches"] == 0
    assert em.barcode_mixture(list(counts), list(counts.values()), 0.02)["mismatches"] > 0.05


def weighted_place(spark, counts):
    """A tag for each barcode at one place, scored by its copies, and a small place beside it."""
    rows = [("c", 0, 30, f"t{i}", float(n), "+", b) for i, (b, n) in enumerate(counts.items())] + [("c", 9, 30, "u", 7.0, "+", "ACGTAC"), ("c", 9, 30, "v", 1.0, "+", "ACGTAA")]
    return spark.createDataFrame(rows, "chrom string, chromStart long, chromEnd long, name string, score double, strand string, barcode string")


def test_collapse_em_of_a_place_with_many_barcodes(spark):
    counts = many_barcodes(2_100)
    fitted, e, _ = all_pairs(counts)
    got = {r.barcode: r for r in collapse.collapse_em(weighted_place(spark, counts), 30, "em-local", weight=True).where("chromStart = 0").collect()}
    assert set(got) == {b for b, (_, sure) in fitted.items() if sure >= 30}
    for b, r in got.items():
        assert (r.n, r.error) == pytest.approx((fitted[b][0], e), rel=1e-6) and r.score == pytest.approx(fitted[b][1], abs=0.006, rel=1e-6)


def test_global_error_of_a_place_with_many_barcodes(spark):
    """The smaller place has too few copies to count."""
    counts = many_barcodes(2_100)
    error = 0.02
    for _ in range(3):
        error = all_pairs(counts, error)[2] / sum(counts.values()) / 6
    assert collapse.global_error_rate(weighted_place(spark, counts), least=9, weight=True) == pytest.approx(error, rel=1e-6)
