"""Expectation maximisation of barcode errors at one position."""

from __future__ import annotations

import math

import numpy as np

ROUNDS, TOLERANCE = 100, 1e-6
LOWEST_ERROR, HIGHEST_ERROR = 0.001, 0.02
#: Barcodes of a place beyond which tag2collapse leaves pairs out (:func:`radius`).
DENSE_LIMIT, LARGE = 1_000, 2_000
#: Places of at most so many barcodes are fitted together; pairs of barcodes held at a time.
TOGETHER, PAIRS = 64, 1 << 20


def radius(barcodes: int, most_copies: float, error: float) -> int | None:
    """Mismatches beyond which tag2collapse holds two barcodes apart; None: no limit.

    Mixtures take every pair of barcodes, however many there are, unless they get it as ``reach``.
    """
    if barcodes <= DENSE_LIMIT:
        return None
    if barcodes > LARGE:
        return 1
    return min(3, math.ceil(math.log(max(most_copies, 1.0)) / math.log(1 / error)))


def _apart(codes: np.ndarray, rows: slice) -> np.ndarray:
    """Mismatches of some barcodes, a row for each, with all of them."""
    d = np.zeros((len(codes[rows]), len(codes)), np.min_scalar_type(codes.shape[1]))
    for letters in codes.T:
        d += letters[rows, None] != letters
    return d


def _posterior(d: np.ndarray, chance: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Chance that copies of each row's barcode came from each origin; sums run in the order of the plain loop."""
    joint = chance[d]
    joint *= alpha
    return joint / joint.cumsum(1)[:, -1:]


def barcode_mixture(barcodes: list[str], copies: list[float], error: float | None = None, reach: int | None = None) -> dict:
    """Tell true barcodes from misread ones.

    Every barcode is a possible origin.  E-step: chance that copies of barcode i came from
    origin k, ``e^d (1-e)^(L-d) alpha_k``; M-step: new shares alpha and, unless ``error``
    is given, a new error rate held in [0.001, 0.02].  All pairs count, a block of rows at a
    time, so no full matrix is held; only with ``reach`` those further apart are left out.

    Returns ``n`` (expected copies of each origin), ``reliability`` (-10 log10 of the chance
    that none of the copies came from it), ``error``, ``mismatches`` and ``total``.
    """
    order = sorted(range(len(barcodes)), key=lambda i: barcodes[i])
    weight = np.array([copies[i] for i in order], float)
    total, length = weight.sum(), len(barcodes[0])
    if len(barcodes) == 1:
        return {"n": [float(total)], "reliability": [100.0], "error": 0.0, "mismatches": 0.0, "total": float(total)}
    fixed = error is not None
    e = error if fixed else HIGHEST_ERROR
    codes = np.array([list(barcodes[i].upper().encode()) for i in order], np.uint8, order="F")
    size, errors = len(order), np.arange(length + 1)
    step = max(1, PAIRS // size)
    blocks = [slice(first, first + step) for first in range(0, size, step)]
    alpha = weight / total
    for _ in range(ROUNDS):
        chance = e**errors * (1 - e) ** (length - errors)
        if reach is not None:
            chance[reach + 1 :] = 0
        old, alpha, mismatches = alpha, np.zeros(size), 0.0
        for rows in blocks:
            d, seen = _apart(codes, rows), weight[rows, None]
            post = _posterior(d, chance, old)
            for share in post * seen:
                alpha += share
            wrong = d * post
            wrong *= seen
            mismatches += float(wrong.sum())
        alpha /= total
        if not fixed:
            e = min(max(mismatches / total / length, LOWEST_ERROR), HIGHEST_ERROR)
        if math.sqrt(((alpha - old) ** 2).mean()) < TOLERANCE:
            break
    reliability = np.zeros(size)
    for rows in blocks:
        post = _posterior(_apart(codes, rows), chance, old)
        for none in weight[rows, None] * np.log10(1 - np.where(post == 1, 1 - 1e-16, post)):
            reliability += none
    reliability *= -10
    back = np.empty(size, int)
    back[order] = np.arange(size)
    return {"n": (alpha * total)[back].tolist(), "reliability": reliability[back].tolist(), "error": float(e), "mismatches": mismatches, "total": float(total)}


def _alike(names: list[list[str]], copies: np.ndarray, error: float | None) -> list[dict]:
    """:func:`barcode_mixture` of places with equally many barcodes, sorted and of one length.

    Sums run in the order of the plain loop, and each place stops in its own round.
    """
    places, size = copies.shape
    codes = np.frombuffer("".join(b for row in names for b in row).upper().encode(), np.uint8).reshape(places, size, -1)
    length = codes.shape[2]
    d = (codes[:, :, None, :] != codes[:, None, :, :]).sum(3)
    total = copies.sum(1)
    e = np.full(places, HIGHEST_ERROR if error is None else error)
    alpha, post, mismatches = copies / total[:, None], np.empty(d.shape), np.zeros(places)
    at = np.arange(places)
    for _ in range(ROUNDS):
        rate, apart, weight, share, whole = e[at, None, None], d[at], copies[at, :, None], alpha[at], total[at]
        joint = rate**apart * (1 - rate) ** (length - apart) * share[:, None, :]
        summed = np.zeros(share.shape)
        for k in range(size):
            summed += joint[:, :, k]
        now = joint / summed[:, :, None]
        shared, new = now * weight, np.zeros(share.shape)
        for i in range(size):
            new += shared[:, i, :]
        new /= whole[:, None]
        wrong = (apart * now * weight).reshape(len(at), -1).sum(1)
        alpha[at], post[at], mismatches[at] = new, now, wrong
        if error is None:
            e[at] = np.minimum(np.maximum(wrong / whole / length, LOWEST_ERROR), HIGHEST_ERROR)
        at = at[np.sqrt(((new - share) ** 2).mean(1)) >= TOLERANCE]
        if not len(at):
            break
    none = copies[:, :, None] * np.log10(1 - np.where(post == 1, 1 - 1e-16, post))
    reliability = np.zeros(copies.shape)
    for i in range(size):
        reliability += none[:, i, :]
    n, reliability = (alpha * total[:, None]).tolist(), (-10 * reliability).tolist()
    return [
        {"n": a, "reliability": r, "error": float(x), "mismatches": float(m), "total": float(t)}
        for a, r, x, m, t in zip(n, reliability, e, mismatches, total, strict=True)
    ]


def barcode_mixtures(names: list[list[str]], copies: list[list[float]], error: float | None = None) -> list[dict]:
    """:func:`barcode_mixture` of many places, those with equally many barcodes in one array."""
    out: list[dict | None] = [None] * len(names)
    kinds: dict[tuple[int, int], list[int]] = {}
    for at, row in enumerate(names):
        alike = 1 < len(row) <= TOGETHER and row == sorted(row) and {len(b) for b in row} == {len(row[0])} and "".join(row).isascii()
        if alike:
            kinds.setdefault((len(row), len(row[0])), []).append(at)
        else:
            out[at] = barcode_mixture(row, copies[at], error)
    for (size, _), places in kinds.items():
        step = max(1, PAIRS // size**2)
        for first in range(0, len(places), step):
            some = places[first : first + step]
            found = _alike([names[at] for at in some], np.array([copies[at] for at in some], float), error)
            for at, fit in zip(some, found, strict=True):
                out[at] = fit
    return out
