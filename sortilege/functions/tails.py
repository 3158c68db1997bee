"""Tail probabilities, for tables of results and never for tables of draws."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-300


def _gamma_series(a: float, x: float) -> float:
    """Lower regularised incomplete gamma function, for x < a + 1."""
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * 1e-17:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def _gamma_fraction(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, for x >= a + 1, by a continued fraction."""
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 100_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or TINY)
        c = b + k / c or TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(a * math.log(x) - x - math.lgamma(a))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function; small values keep their digits."""
    if not a > 0 or x != x:
        return math.nan
    if x <= 0:
        return 0.0
    return _gamma_series(a, x) if x < a + 1 else max(0.0, 1 - _gamma_fraction(a, x))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function; small values keep their digits."""
    if not a > 0 or x != x:
        return math.nan
    if x <= 0:
        return 1.0
    return max(0.0, 1 - _gamma_series(a, x)) if x < a + 1 else _gamma_fraction(a, x)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x) if x < 1 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or TINY)
    h = d
    for m in range(1, 100_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or TINY)
            c = 1 + k / c or TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    return gamma_q(dof / 2, x / 2)


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def poisson_two_sided(seen: int, mean: float) -> float:
    """Doubled tail, at most 1."""
    if not mean > 0:
        return math.nan
    tail = (1.0 if seen <= 0 else gamma_p(seen, mean)) if seen >= mean else gamma_q(seen + 1, mean)
    return min(1.0, 2 * tail)


def binom_cdf(k: int, n: int, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else beta_i(n - k, k + 1, 1 - p)


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X > k)."""
    return 1.0 if k < 0 else 0.0 if k >= n else beta_i(k + 1, n - k, p)


def binom_two_sided(k: int, n: int, p: float) -> float:
    """Sum of the probabilities that are not above that of k (but for rounding): k's own tail, and the other from where it is as unlikely."""
    if n <= 0 or not 0 <= p <= 1:
        return math.nan
    if p in (0.0, 1.0):
        return float(k == n * p)
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    limit, mode = log(k) + 1e-7, min(n, math.floor((n + 1) * p))
    if k == mode:
        return 1.0
    # Beyond the mode the probabilities fall, so the border on the other side is found by halving.
    if k < mode:
        lo, hi = mode, n + 1
        while lo < hi:
            m = (lo + hi) // 2
            lo, hi = (lo, m) if log(m) <= limit else (m + 1, hi)
        return min(1.0, binom_cdf(k, n, p) + binom_sf(lo - 1, n, p))
    lo, hi = -1, mode
    while lo < hi:
        m = (lo + hi + 1) // 2
        lo, hi = (m, hi) if log(m) <= limit else (lo, m - 1)
    return min(1.0, binom_sf(k - 1, n, p) + binom_cdf(lo, n, p))


def normal_two_sided(x: float, mean: float, sd: float) -> float:
    """P(|X| >= |x|) of a normal X."""
    return normal_sf((abs(x) - mean) / sd) + normal_sf((abs(x) + mean) / sd) if sd > 0 else math.nan


def kolmogorov_sf(x: float) -> float:
    """Limit law of the Kolmogorov-Smirnov statistic times root n."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


LAWS = {
    "chi2": lambda x, a, b: chi2_sf(x, a) if a > 0 else math.nan,
    "poisson": lambda x, a, b: poisson_two_sided(round(x), a),
    "binom": lambda x, a, b: binom_two_sided(round(x), round(a), b),
    "normal": normal_two_sided,
    "kolmogorov": lambda x, a, b: kolmogorov_sf(x),
}


def tail(law: str, x: float, a: float, b: float) -> float | None:
    if law not in LAWS or x is None or x != x:
        return None
    p = LAWS[law](x, a, b)
    return p if p == p else None


@F.pandas_udf(DoubleType())
def p_of(law: pd.Series, x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The p-value of x under a law with parameters a and b; null where there is none."""
    return pd.Series([tail(*r) for r in zip(law, x, a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([tail("chi2", a, b, 0.0) for a, b in zip(x, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def poisson_p(seen: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series([tail("poisson", a, b, 0.0) for a, b in zip(seen, mean)], dtype="float64")


@F.pandas_udf(DoubleType())
def binom_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([tail("binom", a, b, c) for a, b, c in zip(k, n, p)], dtype="float64")
