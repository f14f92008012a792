"""Tail probabilities for test statistics: numbers for a model's own figures, columns for tables of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Lower regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2)


def f_tail(x: float, df1: float, df2: float) -> float:
    return _beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * x)) if x > 0 else 1.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_two_sided(t: float, df: float) -> float:
    return f_tail(t * t, 1, df)


def t_quantile(df: float, level: float = 0.95) -> float:
    """The t for which a share level of the distribution lies between -t and t, by halving."""
    lo, hi = 0.0, 2.0
    while t_two_sided(hi, df) > 1 - level:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - level else (lo, mid)
    return hi


# --- as columns: the same sums on whole Arrow batches -------------------------------

TINY = 1e-300
DONE = 1e-15
STIRLING = ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188))


def _log_gammas(x: np.ndarray) -> np.ndarray:
    """Stirling's series, twelve steps further up."""
    up = x + 12
    below = np.log(np.prod([x + i for i in range(12)], axis=0))
    return (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + sum(c / up ** p for p, c in STIRLING) - below


def _nonzero(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, TINY, x)


def _upper_gammas(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma function at x > 0; all rows of a batch take a step together."""
    out = np.exp(-x + a * np.log(x) - _log_gammas(a))
    low = x < a + 1
    if low.any():
        b, y = a[low], x[low]
        term = total = 1 / b
        n = b
        while (term > total * DONE).any():
            n = n + 1
            term = term * y / n
            total = total + term
        out[low] = np.maximum(0, 1 - total * out[low])
    if not low.all():
        b, y = a[~low], x[~low]
        base = y + 1 - b
        c, d = np.full(len(b), 1 / TINY), 1 / base
        h, i, move = d, 0, np.full(len(b), 2.0)
        while (np.abs(move - 1) > DONE).any():
            i += 1
            base = base + 2
            d = 1 / _nonzero(base - i * (i - b) * d)
            c = _nonzero(base - i * (i - b) / c)
            move = np.where(np.abs(move - 1) > DONE, c * d, 1)      # a row that has converged stays as it is
            h = h * move
        out[~low] *= h
    return out


def _lower_betas(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lower regularised incomplete beta function at 0 < x < 1; beyond the mean the other side is summed."""
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    front = np.exp(_log_gammas(a + b) - _log_gammas(a) - _log_gammas(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones(len(a)), 1 / _nonzero(1 - (a + b) * x / (a + 1))
    h, m, move = d, 0, np.full(len(a), 2.0)
    while (np.abs(move - 1) > DONE).any():
        m += 1
        both = np.ones(len(a))
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _nonzero(1 + num * d)
            c = _nonzero(1 + num / c)
            both = both * c * d
        move = np.where(np.abs(move - 1) > DONE, both, 1)
        h = h * move
    return np.where(turned, 1 - front * h, front * h)


def _columns(*cols: pd.Series) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns as doubles, and which rows lack none of them and have positive degrees of freedom."""
    got = [c.to_numpy(dtype=float, na_value=np.nan) for c in cols]
    return got, ~np.isnan(got).any(axis=0) & (np.array(got[1:]) > 0).all(axis=0)


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    (x, df), good = _columns(x, df)
    out = np.where(good, np.where(x <= 0, 1.0, 0.0), np.nan)
    inner = good & (x > 0) & np.isfinite(x)
    out[inner] = _upper_gammas(df[inner] / 2, x[inner] / 2)
    return pd.Series(pd.arrays.FloatingArray(out, ~good))


@F.pandas_udf(DoubleType())
def _f(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    (x, df1, df2), good = _columns(x, df1, df2)
    with np.errstate(all="ignore"):
        share = np.where(good & (x > 0), df2 / (df2 + df1 * x), 1.0)
    out = np.where(good, (share >= 1).astype(float), np.nan)
    inner = good & (share > 0) & (share < 1)
    out[inner] = _lower_betas(df2[inner] / 2, df1[inner] / 2, share[inner])
    return pd.Series(pd.arrays.FloatingArray(out, ~good))


def chi2_p(x: Column, df: Column) -> Column:
    """P(X > x); null without a number or positive degrees of freedom, 1 from zero down, 0 at infinity."""
    return _chi2(x.cast("double"), df.cast("double"))


def f_p(x: Column, df1: Column, df2: Column) -> Column:
    """P(X > x) of the F distribution; the same rules."""
    return _f(x.cast("double"), df1.cast("double"), df2.cast("double"))


def normal_p(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution."""
    return chi2_p(z * z, F.lit(1))


def t_p(t: Column, df: Column) -> Column:
    """Two-sided tail of the t distribution."""
    return f_p(t * t, F.lit(1), df)
