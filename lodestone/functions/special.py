"""Distribution functions that Spark lacks, in numpy over Arrow batches: the normal, t and beta distributions, and the exact interval of a share.

Beta probabilities are regularised incomplete beta functions by their continued fraction (modified Lentz), good to some 1e-14; quantiles are found by bisection, which needs no
derivative and never leaves its bracket.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY, _EPS, _STEPS = 1e-300, 1e-16, 10_000
_log_gamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    away = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c = np.ones_like(x)
    d = 1 / away(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, _STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / away(1 + term * d)
            c = away(1 + term / c)
            step = c * d
            out = out * step
        if (np.abs(step - 1) < _EPS * 8).all():
            break
    return out


def _stirling(x: np.ndarray) -> np.ndarray:
    """What Stirling's formula lacks of log gamma, from 10 on."""
    y = 1 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x


def _log_peak(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(m**a (1 - m)**b / B(a, b)) with m = a / (a + b), where terms that grow with a or b cancel by hand."""
    p, q = np.minimum(a, b), np.maximum(a, b)
    m = p / (p + q)
    small = np.minimum(q, 10.0)
    plain = (_log_gamma(np.minimum(p, 10) + small) - _log_gamma(np.minimum(p, 10)) - _log_gamma(small)).astype(float) + p * np.log(m) + q * np.log1p(-m)
    far = np.maximum(q, 10.0)
    one = p * np.log(p) - p - _log_gamma(np.minimum(p, 1e6)).astype(float) + np.log1p(-m) / 2 + _stirling(far + p) - _stirling(far)
    near = np.maximum(p, 10.0)
    both = np.log(p / (2 * math.pi) * (q / (p + q))) / 2 + _stirling(near + far) - _stirling(near) - _stirling(far)
    return np.where(q < 10, plain, np.where(p < 10, one, both))


def incomplete_beta(a, b, x) -> np.ndarray:
    """I_x(a, b) for a, b > 0; x outside 0 to 1 counts as the nearer end."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    x = np.clip(x, 0, 1)
    inner = (x > 0) & (x < 1)
    out = np.where(x >= 1, 1.0, 0.0)
    if inner.any():
        p, q, y = a[inner], b[inner], x[inner]
        swap = y > (p + 1) / (p + q + 2)
        p, q, y = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - y, y)
        # Powers are taken relative to the mean, so that large parameters don't cancel.
        mean = p / (p + q)
        front = _log_peak(p, q) + p * np.log1p((y - mean) / mean) + q * np.log1p((mean - y) / (q / (p + q)))
        value = np.exp(front) * _fraction(p, q, y) / p
        out = out.copy()
        out[inner] = np.where(swap, 1 - value, value)
    return out


def beta_quantile(a, b, p) -> np.ndarray:
    """x with I_x(a, b) = p."""
    a, b, p = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(p, float))
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(60):
        middle = (low + high) / 2
        below = incomplete_beta(a, b, middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def share_interval(k, n, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """The Clopper-Pearson interval of k of n: from 0 where none, to 1 where all; 0 to 1 for n = 0."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    tail = (1 - level) / 2
    none, all_ = k <= 0, k >= n
    low = np.where(none, 0.0, beta_quantile(np.where(none, 1, k), n - k + 1, tail))
    high = np.where(all_, 1.0, beta_quantile(k + 1, np.where(all_, 1, n - k), 1 - tail))
    return low, high


def t_tails(t, df) -> np.ndarray:
    """P(|T| >= |t|) with df degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_upper(z) -> np.ndarray:
    """P(Z >= z)."""
    return (_erfc(np.asarray(z, float) / math.sqrt(2)) / 2).astype(float)


def _over(function, *arrays: pd.Series) -> pd.Series:
    """function of the rows without nulls; null for the others."""
    known = ~np.logical_or.reduce([x.isna().to_numpy() for x in arrays])
    out = pd.Series(np.full(len(arrays[0]), np.nan)).astype(object)
    if known.any():
        out[known] = function(*[x.to_numpy(dtype=float, na_value=np.nan)[known] for x in arrays])
    return out.where(known, None).astype("Float64")


def _column(function, *columns: Column) -> Column:
    """function as a Column; built here, as workers import this module without a session."""

    def of(*arrays: pd.Series) -> pd.Series:
        return _over(function, *arrays)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return of(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return of(a, b, c)

    def one(a: pd.Series) -> pd.Series:
        return of(a)

    udf = F.pandas_udf({1: one, 2: two, 3: three}[len(columns)], "double")
    return udf(*[c.cast("double") for c in columns])


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic; null for nulls."""
    return _column(t_tails, t, df)


def normal_greater(z: Column) -> Column:
    """One-sided p (greater) of a z; null for nulls."""
    return _column(normal_upper, z)


def beta_probability(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b); null for nulls."""
    return _column(incomplete_beta, a, b, x)


def clopper_pearson(k: Column, n: Column, level: float = 0.95) -> Column:
    """struct<low, high>: the exact interval of a share of k in n; nulls for nulls."""
    ends = [_column(lambda a, b, i=i: share_interval(a, b, level)[i], k, n) for i in (0, 1)]
    return F.struct(ends[0].alias("low"), ends[1].alias("high"))
