"""Statistical kernels in numpy, and their vectorised column functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def binomial_two_sided(hits: int, trials: int, p: float) -> float:
    """Exact two-sided p-value: all outcomes no likelier than the observed one."""
    if trials <= 0 or p <= 0 or p >= 1:
        return 1.0
    k = np.arange(trials + 1)
    log_pmf = math.lgamma(trials + 1) - _LGAMMA(k + 1) - _LGAMMA(trials - k + 1) + k * math.log(p) + (trials - k) * math.log1p(-p)
    rarer = log_pmf <= log_pmf[hits] + math.log1p(1e-7)
    return float(min(1.0, np.exp(log_pmf[rarer]).sum()))


#: Terms that are held at once for rows of one height.
_TERMS = 1 << 20


def scan_p_value(height: int, mean: float, windows: float) -> float:
    """Chance that some window of a Poisson process holds ``height`` points or more.

    Naus' approximation (1982): 1 - Q2 (Q3 / Q2)^(L - 2) for a mean of ``mean`` points in a
    window and ``windows`` = L windows.
    """
    return float(scan_p_values(np.array([int(height)]), np.array([float(mean)]), np.array([float(windows)]))[0])


def scan_p_values(height: np.ndarray, mean: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """:func:`scan_p_value` of many: rows of one height share their terms and go together."""
    out = np.ones(len(height))
    order = np.argsort(height, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(height[order])) + 1):
        k = int(height[rows[0]]) if len(rows) else 0
        if k <= 0:
            continue
        some = rows[mean[rows] > 0]
        out[rows[~(mean[rows] > 0)]] = 0.0
        for part in np.array_split(some, len(some) * (2 * k + 1) // _TERMS + 1):
            out[part] = _scan_of_height(k, mean[part], windows[part])
    return out


def _scan_of_height(k: int, mean: np.ndarray, windows: np.ndarray) -> np.ndarray:
    if k == 1:
        return -np.expm1(-mean * windows)
    i = np.arange(2 * k + 1)[:, None]
    pmf = np.exp(i * np.log(mean) - mean - _LGAMMA(i + 1.0))
    cdf, none = np.minimum(np.cumsum(pmf, axis=0), 1.0), np.zeros(len(mean))
    p = lambda n: pmf[n] if n >= 0 else none
    c = lambda n: cdf[n] if n >= 0 else none
    q2 = c(k - 1) ** 2 - (k - 1) * p(k) * p(k - 2) - (k - 1 - mean) * p(k) * c(k - 3)
    a1 = 2 * p(k) * c(k - 1) * ((k - 1) * c(k - 2) - mean * c(k - 3))
    a2 = 0.5 * p(k) ** 2 * ((k - 1) * (k - 2) * c(k - 3) - 2 * (k - 2) * mean * c(k - 4) + mean**2 * c(k - 5))
    a3 = sum(p(2 * k - r) * c(r - 1) ** 2 for r in range(1, k))
    a4 = sum(p(2 * k - r) * p(r) * ((r - 1) * c(r - 2) - mean * c(r - 3)) for r in range(2, k))
    q3 = c(k - 1) ** 3 - a1 + a2 + a3 - a4
    known = (q2 > 0) & (q3 > 0)
    q2, q3 = np.where(known, q2, 1.0), np.where(known, q3, 1.0)
    found = -np.expm1(np.log(q2) + (windows - 2) * (np.log(q3) - np.log(q2)))
    return np.where(known, np.minimum(1.0, np.maximum(0.0, found)), 1.0)


def _per_row(function, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if any(x is None or x != x for x in row) else function(*row) for row in zip(*batch, strict=True)], dtype="float64")

    return apply(*columns)


def scan_p(height: Column, mean: Column, windows: Column) -> Column:
    """:func:`scan_p_value` of each row; call it on distinct rows and join back."""

    @F.pandas_udf("double")
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for h, m, w in batches:
            known = (h.notna() & m.notna() & w.notna()).to_numpy()
            out = np.full(len(h), np.nan)
            out[known] = scan_p_values(h.to_numpy()[known].astype(np.int64), m.to_numpy()[known].astype(float), w.to_numpy()[known].astype(float))
            yield pd.Series(out).where(known, None).astype("Float64")

    return apply(height.cast("double"), mean, windows)


def binomial_p(hits: Column, trials: Column, p: Column) -> Column:
    return _per_row(lambda h, n, q: binomial_two_sided(int(h), int(n), q), hits.cast("double"), trials.cast("double"), p)


def phred(p: Column) -> Column:
    """-10 log10 p, with p held between 1e-100 and 1."""
    return -10 * F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-100)))
