"""Binomial tail helpers for small parameter tables (one row per threshold)."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMITS = ("lower_95", "upper_95", "upper_one_sided_95")

# Python workers get these helpers with the task, wherever the package is installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter((math.lgamma(v) for v in x), float, x.size)


def _tail_from(n: int, p: float, lo: int, hi: int) -> np.ndarray:
    """P(Bin(n, p) >= j) for j = lo..hi, neglecting mass above hi."""
    j = np.arange(lo, hi + 1, dtype=float)
    log_pmf = (math.lgamma(n + 1) - _lgamma(j + 1) - _lgamma(n - j + 1)
               + j * math.log(p) + (n - j) * math.log1p(-p))
    return np.cumsum(np.exp(log_pmf)[::-1])[::-1]


def tolerance_index(m0: int, alpha: float, delta: float) -> int:
    """Smallest k in 1..m0+1 with P(Bin(m0, 1 - alpha) >= k) <= delta.

    Only ranks within 40 standard deviations of the mean can matter, so the work
    grows with sqrt(m0).
    """
    if m0 <= 0:
        return 1 if m0 == 0 else m0 + 1
    p = 1.0 - alpha
    spread = 40.0 * math.sqrt(m0 * p * alpha) + 40.0
    lo, hi = max(1, int(m0 * p - spread)), min(m0, int(m0 * p + spread))
    ok = np.flatnonzero(_tail_from(m0, p, lo, hi) <= delta)
    return int(lo + ok[0]) if ok.size else hi + 1


def _upper_tail(s: int, n: int, p: float) -> float:
    """P(Bin(n, p) >= s), summed on the side of the mean that holds less mass."""
    if s <= 0:
        return 1.0
    if s > n or p <= 0.0:
        return 0.0
    if p >= 1.0:
        return 1.0
    spread = 40.0 * math.sqrt(n * p * (1 - p)) + 40.0
    lo, hi = max(0, int(n * p - spread)), min(n, int(n * p + spread))
    if s > hi:
        return 0.0
    if s <= lo:
        return 1.0
    if s > n * p:
        return float(_tail_from(n, p, s, hi)[0])
    return 1.0 - float(_tail_from(n, p, lo, s - 1)[0])


def _solve(s: int, n: int, target: float) -> float:
    """p with P(Bin(n, p) >= s) = target, by bisection (the tail grows with p)."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        if _upper_tail(s, n, mid) < target:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def exact_limits(s: int, n: int, confidence: float) -> tuple[float, float, float]:
    """Two-sided lower and upper, and one-sided upper, exact binomial limits."""
    if n <= 0:
        return (math.nan,) * 3
    tail = (1 - confidence) / 2
    lower = 0.0 if s == 0 else _solve(s, n, tail)
    upper = 1.0 if s == n else _solve(s + 1, n, 1 - tail)
    one_sided = 1.0 if s == n else _solve(s + 1, n, confidence)
    return lower, upper, one_sided


@F.pandas_udf(T.LongType())
def _tolerance_udf(m0: pd.Series, alpha: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series([tolerance_index(int(m), float(a), float(d)) for m, a, d in zip(m0, alpha, delta)])


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in LIMITS]))
def _limits_udf(s: pd.Series, n: pd.Series, confidence: pd.Series) -> pd.DataFrame:
    rows = [exact_limits(int(a), int(b), float(c)) for a, b, c in zip(s, n, confidence)]
    return pd.DataFrame(rows, columns=list(LIMITS))


def hc_index(m0: Column, alpha: Column, delta: float | Column) -> Column:
    """High-confidence rank; for tables with one row per threshold, not for row data."""
    delta = delta if isinstance(delta, Column) else F.lit(float(delta))
    return _tolerance_udf(m0.cast("long"), alpha.cast("double"), delta)


def binomial_limits(successes: Column, n: Column, confidence: float = 0.95) -> Column:
    """Struct of exact limits; NULL fields when n is zero. For grouped rows only."""
    out = _limits_udf(successes.cast("long"), n.cast("long"), F.lit(float(confidence)))
    return F.when(n > 0, out)
