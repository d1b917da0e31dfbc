"""Special functions on numpy arrays, and as Arrow-batched column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)], out[ok & (x == 1)] = 0.0, 1.0
    ok &= (x > 0) & (x < 1)
    if not ok.any():
        return out
    a, b, x = a[ok], b[ok], x[ok]
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for step in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = front * h
    out[ok] = np.where(swap, 1 - value, value)
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Twice the upper tail of Student's distribution at ``|t|``; nan where not defined."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return betainc(df / 2, np.full(df.shape, 0.5), df / (df + t * t))


def gammainc(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi2_ppf(q: float, df: int) -> float:
    """The value below which a chi-squared variable stays with probability ``q``."""
    low, high = 0.0, max(df, 1) * 2.0
    while gammainc(df / 2, high / 2) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if gammainc(df / 2, mid / 2) < q:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _z_p(z: pd.Series) -> pd.Series:
    return pd.Series(_erfc(np.abs(z.to_numpy(float)) / math.sqrt(2)))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic; 1 where it isn't defined."""
    p = _t_p(t, df)
    return F.when(p.isNull() | F.isnan(p), F.lit(1.0)).otherwise(p)


def z_p_value(z: Column) -> Column:
    """Two-sided p of a normal statistic; 1 where it is null."""
    p = _z_p(z)
    return F.when(p.isNull() | F.isnan(p), F.lit(1.0)).otherwise(p)
