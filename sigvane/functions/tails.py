"""Tail probabilities, evaluated on result rows only (one row per coefficient or correlation)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float | None, df: float | None) -> float | None:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def t_critical(df: float, level: float = 0.95) -> float:
    """The t value with two-sided tail ``1 - level``, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        if t_two_sided(middle, df) > 1 - level:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def z_two_sided(z: float | None) -> float | None:
    if z is None or math.isnan(z):
        return None
    return math.erfc(abs(z) / math.sqrt(2.0))


def correlation_t(rho: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return rho * np.sqrt((n - 2) / ((rho + 1.0) * (1.0 - rho)))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series([z_two_sided(v) for v in z.astype(float)], dtype=float)


@F.pandas_udf(T.DoubleType())
def correlation_pvalue(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a rank correlation from t with n - 2 degrees of freedom."""
    r, size = rho.astype(float).to_numpy(), n.astype(float).to_numpy()
    t = correlation_t(r, size)
    return pd.Series([t_two_sided(a, b - 2) for a, b in zip(t, size, strict=True)], dtype=float)
