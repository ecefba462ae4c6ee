"""Tail probabilities, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for x below its turning point, by Lentz's continued fraction."""
    tiny = 1e-300
    lg = np.vectorize(math.lgamma)
    with np.errstate(all="ignore"):
        front = np.exp(lg(a + b) - lg(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        c = np.ones_like(x)
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + top / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
            if np.all(np.abs(c * d - 1) < 1e-13):
                break
    return np.where(x <= 0, 0.0, front * f)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p value of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    small = x < (a + 1) / (a + b + 2)
    low = incomplete_beta(a, b, np.where(small, x, 0.0))
    # the other tail by symmetry, I_x(a, b) = 1 - I_{1-x}(b, a)
    high = np.array([1 - _beta_at(b, ai, 1 - xi) if not s else 0.0 for ai, xi, s in zip(a, x, small, strict=True)])
    return np.where(small, low, high)


def _beta_at(a: float, b: float, x: float) -> float:
    return float(incomplete_beta(np.array([a]), b, np.array([x]))[0])


@F.pandas_udf(DoubleType())
def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    r, n = r.to_numpy(float), n.to_numpy(float)
    out = np.full(len(r), np.nan)
    ok = np.isfinite(r) & (n > 2)
    exact = ok & (np.abs(r) >= 1)
    out[exact] = 0.0
    ok &= ~exact
    if ok.any():
        df = n[ok] - 2
        out[ok] = t_two_sided(r[ok] * np.sqrt(df / (1 - r[ok] ** 2)), df)
    return pd.Series(out).where(np.isfinite(out), None)


def correlation_p(r: Column | str, n: Column | str) -> Column:
    """Two-sided p of a correlation over n rows; null for a null r or fewer than three rows."""
    return _correlation_p(r, n)
