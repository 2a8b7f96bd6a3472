"""Scalar statistics: chi-square tails and quantiles, incomplete gamma and beta, Fisher's exact test, robust scale."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def gamma_p(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function of non-negative x."""
    x = np.asarray(x, float)
    return np.where(x < a + 1, _series(a, np.minimum(x, a + 1)), 1 - _fraction(a, np.maximum(x, a + 1)))


def gamma_q(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function; small tails keep their precision."""
    x = np.asarray(x, float)
    return np.where(x < a + 1, 1 - _series(a, np.minimum(x, a + 1)), _fraction(a, np.maximum(x, a + 1)))


def _front(a: float, x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.exp(a * np.log(x) - x - math.lgamma(a))


def _series(a: float, x: np.ndarray) -> np.ndarray:
    """x^a e^-x / Gamma(a) times the sum of x^n / (a (a+1) .. (a+n))."""
    term = np.full(x.shape, 1 / a)
    total = term.copy()
    for n in range(1, 2000):
        term = term * x / (a + n)
        total += term
        if (term <= total * 1e-17).all():
            break
    return np.where(x > 0, _front(a, x) * total, 0.0)


def _fraction(a: float, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the upper tail, from the front, by ratios of successive convergents."""
    b = x + 1 - a
    c, d = np.full(x.shape, 1 / _TINY), 1 / b
    out = d.copy()
    for n in range(1, 2000):
        num = n * (a - n)
        b = b + 2
        d = num * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + num / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = c * d
        out = out * step
        if (np.abs(step - 1) < 1e-16).all():
            break
    return _front(a, x) * out


def pchisq(x, df: float, lower: bool = True) -> np.ndarray:
    """Chi-square distribution function or upper tail: NaN for NaN or df <= 0, and the limits at 0 and infinity."""
    x = np.asarray(x, float)
    if not df > 0:
        return np.full(x.shape, np.nan)
    inside = np.isfinite(x) & (x > 0)
    half = np.where(inside, x / 2, 1.0)
    tail = (gamma_p if lower else gamma_q)(df / 2, half)
    ends = np.where(x > 0, 1.0, 0.0) if lower else np.where(x > 0, 0.0, 1.0)
    return np.where(np.isnan(x), np.nan, np.where(inside, tail, ends))


def qchisq(p: float, df: float) -> float:
    """The x whose distribution function is p: Newton steps kept within a shrinking bracket."""
    if not (0 <= p <= 1 and df > 0):
        return math.nan
    if p in (0.0, 1.0):
        return 0.0 if p == 0 else math.inf
    low, high = 0.0, max(4.0, 2 * df)
    while pchisq(high, df) < p:
        high *= 2
    x = df
    for _ in range(200):
        over = float(pchisq(x, df)) - p
        low, high = (low, x) if over > 0 else (x, high)
        density = math.exp((df / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(df / 2)) / 2
        new = x - over / density if density else low
        new = new if low < new < high else (low + high) / 2
        if abs(new - x) <= 1e-14 * x:
            return new
        x = new
    return x


def chisq1(x) -> np.ndarray:
    """Upper tail with one degree of freedom; NaN counts as 1, and so does what is not positive."""
    x = np.asarray(x, float)
    return np.where(np.isnan(x), 1.0, pchisq(np.where(np.isnan(x), 0, x), 1, lower=False))


def chi_square_tail(x: Column, df: int = 1) -> Column:
    """Column of upper-tail chi-square probabilities, a batch at a time."""

    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return pd.Series(pchisq(s.to_numpy(float), df, lower=False))

    return tail(x)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for n in range(500):
        m = n // 2
        num = 1.0 if n == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if n % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or _TINY)
        c = 1 + num / c or _TINY
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (out - 1)


def hypergeometric(n11: int, row: int, col: int, n: int) -> float:
    """Chance of n11 in the first cell, given the margins."""
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return math.exp(choose(row, n11) + choose(n - row, col - n11) - choose(n, col))


def fisher_exact(n11: int, n12: int, n21: int, n22: int) -> tuple[float, float, float, float]:
    """Chance of the table, and the left, right and two-sided tails."""
    row, col, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    ks = range(max(0, row + col - n), min(row, col) + 1)
    p = {k: hypergeometric(k, row, col, n) for k in ks}
    own = p[n11]
    return own, min(1.0, sum(v for k, v in p.items() if k <= n11)), min(1.0, sum(v for k, v in p.items() if k >= n11)), min(1.0, sum(v for v in p.values() if v <= own * (1 + 1e-7)))


def is_close(a: Column, b: Column, rel: float = 1e-9) -> Column:
    """Whether two numbers differ by no more than `rel` of the larger; only 0 is close to 0."""
    return (a == b) | (F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b)))


def mad(x: np.ndarray) -> float:
    """1.4826 times the median distance from the median; if that is 0 the deviation (N - 1), and if that is 0, 1."""
    spread = 1.4826 * float(np.median(np.abs(x - np.median(x))))
    if spread > 0:
        return spread
    sd = float(np.std(x, ddof=1)) if len(x) > 1 else 0.0
    return sd if sd > 0 else 1.0


def significant(x: Column, digits: int = 6) -> Column:
    """A number as text with so many significant digits."""
    return F.format_string(f"%.{digits}g", x)
