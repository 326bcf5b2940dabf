"""Normal, chi-squared, F and t probabilities, which Spark has no functions for, as Arrow functions of whole columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lanczos coefficients (g = 7) and those of the rational start of the normal quantile.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TAIL_A, _TAIL_B = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
_TINY = 1e-300


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, float) - 1
    total = _LANCZOS[0] + sum(c / (x + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def gamma_tail(a: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Upper regularised incomplete gamma function: a series below a + 1, a continued fraction above, all elements side by side."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0))
    safe = np.where(x > 0, x, 1.0)
    front = np.exp(-safe + a * np.log(safe) - log_gamma(a))
    small = np.where(x < a + 1, safe, 0.5)
    term = total = 1 / a
    for k in range(1, rounds):
        term = term * small / (a + k)
        total = total + term
        if np.all(term <= 1e-17 * total):
            break
    large = np.where(x < a + 1, a + 2, safe)
    b = large + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for k in range(1, rounds):
        an, b = -k * (k - a), b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    return np.where(x <= 0, 1.0, np.clip(np.where(x < a + 1, 1 - front * total, front * h), 0, 1))


def beta_part(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inside = (y > 0) & (y < 1)
    y = np.where(inside, y, 0.5)
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log(1 - y)) / p
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d
    for k in range(1, rounds):
        for part in (k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1))):
            d = 1 + part * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + part / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    value = np.where(inside, front * h, 0.0)
    return np.where(turn, 1 - value, value)


def normal_probability(x: np.ndarray) -> np.ndarray:
    """P(X < x) of a standard normal."""
    tail = 0.5 * gamma_tail(0.5, np.asarray(x, float) ** 2 / 2)
    return np.where(np.asarray(x) > 0, 1 - tail, tail)


def normal_inverse(p: np.ndarray) -> np.ndarray:
    """Inverse of normal_probability by a rational start and three steps of Newton's method, from the nearer end."""
    p = np.asarray(p, float)
    q = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(np.maximum(q, 1e-300)))
    x = t - (_TAIL_A[0] + t * (_TAIL_A[1] + t * _TAIL_A[2])) / (1 + t * (_TAIL_B[0] + t * (_TAIL_B[1] + t * _TAIL_B[2])))
    for _ in range(3):
        x = x + (0.5 * gamma_tail(0.5, x * x / 2) - q) * np.sqrt(2 * np.pi) * np.exp(x * x / 2)
    return np.where(p < 0.5, -x, x)


def chi_squared_tail(x: np.ndarray | float, df: np.ndarray | int) -> np.ndarray:
    """P(X > x)."""
    return gamma_tail(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def f_tail(x: np.ndarray | float, df1: np.ndarray | float, df2: np.ndarray | float) -> np.ndarray:
    """P(X > x) of an F distribution."""
    x, a, b = (np.asarray(v, float) for v in (x, df1, df2))
    return beta_part(b / 2, a / 2, b / (b + a * np.maximum(x, 0)))


def _column(values: np.ndarray, *inputs: pd.Series) -> pd.Series:
    missing = np.any([s.isna().to_numpy() for s in inputs], axis=0)
    return pd.Series(np.where(missing, np.nan, values)).astype(object).where(~missing, None)


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return _column(normal_probability(x.fillna(0.0).to_numpy(float)), x)


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Inverse of normal_cdf, p kept within 1e-6 of the ends."""
    return _column(normal_inverse(p.fillna(0.5).clip(1e-6, 1 - 1e-6).to_numpy(float)), p)


@F.pandas_udf(T.DoubleType())
def chi_squared_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _column(chi_squared_tail(x.fillna(0.0).to_numpy(float), df.fillna(1).to_numpy(float)), x, df)


@F.pandas_udf(T.DoubleType())
def f_p(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _column(f_tail(x.fillna(0.0).to_numpy(float), df1.fillna(1).to_numpy(float), df2.fillna(1).to_numpy(float)), x, df1, df2)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a Pearson correlation of n pairs."""
    df = np.maximum(n.fillna(3).to_numpy(float) - 2, 1)
    x = r.fillna(0.0).to_numpy(float)
    return _column(f_tail(x * x * df / np.maximum(1 - x * x, 1e-12), 1.0, df), r, n)
