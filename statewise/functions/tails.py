"""Tail areas of the normal, Student t and chi-square laws (vectorised, numpy only)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
_ERFC = np.vectorize(math.erfc, otypes=[float])


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.nanmax(np.abs(d * c - 1.0), initial=0.0) < 1e-15:
            break
    return h


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, b, x)])
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(_LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + a * np.log(inner) + b * np.log1p(-inner))
    swap = inner > (a + 1.0) / (a + b + 2.0)
    first, second = np.where(swap, b, a), np.where(swap, a, b)
    part = front * _beta_fraction(first, second, np.where(swap, 1.0 - inner, inner)) / first
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1.0 - part, part)))


def upper_gamma(a, x):
    """Regularised upper incomplete gamma function Q(a, x)."""
    a, x = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, x)])
    safe = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(safe) - safe - _LGAMMA(a))
    term = 1.0 / a
    series = term.copy()
    for n in range(1, 2000):
        term = term * safe / (a + n)
        series = series + term
        if np.nanmax(np.abs(term / series), initial=0.0) < 1e-16:
            break
    tiny = 1e-300
    b = safe + 1.0 - a
    d = 1.0 / np.where(np.abs(b) < tiny, tiny, b)
    c = np.full_like(safe, 1.0 / tiny)
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if np.nanmax(np.abs(d * c - 1.0), initial=0.0) < 1e-15:
            break
    with np.errstate(all="ignore"):
        out = np.where(safe < a + 1.0, 1.0 - front * series, front * h)
    return np.where(x <= 0, 1.0, out)


def _nullable(values, missing) -> pd.Series:
    return pd.Series(np.where(missing, np.nan, values)).replace({np.nan: None}).astype("object")


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    x = z.to_numpy(dtype=float)
    return _nullable(_ERFC(np.abs(np.nan_to_num(x)) / math.sqrt(2.0)), np.isnan(x))


@pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    x = z.to_numpy(dtype=float)
    return _nullable(0.5 * _ERFC(np.nan_to_num(x) / math.sqrt(2.0)), np.isnan(x))


@pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    x, n = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
    missing = np.isnan(x) | np.isnan(n) | ~(n > 0)
    x, n = np.where(missing, 0.0, x), np.where(missing, 1.0, n)
    return _nullable(incomplete_beta(n / 2.0, 0.5, n / (n + x * x)), missing)


@pandas_udf(DoubleType())
def chi_square_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    v, n = x.to_numpy(dtype=float), df.to_numpy(dtype=float)
    missing = np.isnan(v) | np.isnan(n) | ~(n > 0)
    return _nullable(upper_gamma(np.where(missing, 1.0, n) / 2.0, np.where(missing, 0.0, v) / 2.0), missing)


def student_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the tail area (p > 0.5)."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        upper = 0.5 * float(incomplete_beta(df / 2.0, 0.5, df / (df + mid * mid)))
        low, high = (mid, high) if upper > 1 - p else (low, mid)
    return (low + high) / 2


NORMAL_975 = 1.959963984540054
