"""Tails of the usual distributions as Arrow-batched functions, for small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def norm_sf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = 1e-300
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def gamma_sf(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma function."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        front = np.exp(-x + s * np.log(x) - _lgamma(s))
        term = total = 1 / s
        for k in range(1, 2000):
            term = term * x / (s + k)
            total = total + term
            if np.all(~(np.abs(term) > 1e-17 * np.abs(total))):
                break
        series = 1 - front * total
        b = x + 1 - s
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for i in range(1, 2000):
            an, b = -i * (i - s), b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if np.all(~(np.abs(d * c - 1) > 1e-15)):
                break
        return np.where(x <= 0, 1.0, np.where(x < s + 1, series, front * h))


def beta_ppf(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantile of the beta distribution by bisection."""
    q, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (q, a, b)))
    low, high = np.zeros_like(q), np.ones_like(q)
    for _ in range(60):
        mid = (low + high) / 2
        up = beta_inc(a, b, mid) < q
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def _series(*columns: pd.Series) -> list[np.ndarray]:
    return [c.astype("float64").to_numpy() for c in columns]


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    (x,) = _series(z)
    return pd.Series(np.minimum(1.0, 2 * norm_sf(np.abs(x))))


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    x, n = _series(t, df)
    ok = np.isfinite(x) & (n > 0)
    out = np.full(len(x), np.nan)
    out[ok] = beta_inc(n[ok] / 2, 0.5, n[ok] / (n[ok] + x[ok] ** 2))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    x, a, b = _series(f, d1, d2)
    ok = np.isfinite(x) & (x >= 0) & (a > 0) & (b > 0)
    out = np.full(len(x), np.nan)
    out[ok] = beta_inc(b[ok] / 2, a[ok] / 2, b[ok] / (b[ok] + a[ok] * x[ok]))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    v, k = _series(x, df)
    ok = np.isfinite(v) & (k > 0)
    out = np.full(len(v), np.nan)
    out[ok] = gamma_sf(k[ok] / 2, v[ok] / 2)
    return pd.Series(out)


def clopper_pearson_upper(k: np.ndarray, n: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Upper bound of an error rate; 1 where nothing was seen or all was wrong."""
    k, n, alpha = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, alpha)))
    out = np.ones(len(k))
    ok = (n > 0) & (k < n)
    out[ok] = beta_ppf(1 - alpha[ok], k[ok] + 1, n[ok] - k[ok])
    return out
