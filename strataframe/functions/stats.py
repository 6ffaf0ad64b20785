"""Closed-form statistics as column expressions; special functions Spark lacks as Arrow-batched UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

Z95 = 1.959963984540054


def concordant(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson's r; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def fisher_z(r: Column, n: Column, side: int) -> Column:
    """End of the 95% interval of a correlation; null below 4 pairs or at |r| = 1."""
    return F.when((n >= 4) & (F.abs(r) < 1), F.tanh(F.atanh(r) + side * Z95 / F.sqrt(F.greatest(n - 3, F.lit(1)).cast("double"))))


def wald(p: Column, n: Column, side: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p + side * Z95 * F.sqrt(p * (1 - p) / n)))


def wilson(k: Column, n: Column, side: int) -> Column:
    p, z2 = k / n, Z95 * Z95
    return (p + z2 / (2 * n) + side * Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def simes(ps: Column) -> Column:
    """Least of p(i) * n / i over the sorted p-values of an array, at most 1."""
    n = F.size(ps).cast("double")
    return F.least(F.lit(1.0), F.array_min(F.transform(F.array_sort(ps), lambda p, i: p * n / (i + 1))))


def acat(ps: Column) -> Column:
    """Cauchy combination of an array of p-values, clipped to [1e-15, 1 - 1e-15]."""
    t = F.transform(ps, lambda p: F.tan((0.5 - F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))) * math.pi))
    return 0.5 - F.atan(F.aggregate(t, F.lit(0.0), lambda a, x: a + x) / F.size(ps)) / math.pi


def safe_exp(x: Column) -> Column:
    return F.when(x > 700, F.lit(float("inf"))).when(x < -700, F.lit(0.0)).otherwise(F.exp(x))


def chi2_p2(x: Column) -> Column:
    """Upper tail with two degrees of freedom, in closed form."""
    return F.exp(-x / 2)


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(v) if v is not None else None)


def normal_p(z: Column) -> Column:
    """Two-sided."""
    return erfc(F.abs(z) / math.sqrt(2))


def chi2_p1(x: Column) -> Column:
    return erfc(F.sqrt(x / 2))


def sign_p(values: Column) -> Column:
    """Aggregate: two-sided p of bootstrap differences with one added to each count."""
    n = F.count(values)
    tail = lambda c: (F.count_if(c) + 1) / (n + 1)
    return F.least(F.lit(1.0), 2 * F.least(tail(values <= 0), tail(values >= 0)))


def fisher_exact_value(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: tables no likelier than this one."""
    r1, r2, c1 = a + b, c + d, a + c
    lf = math.lgamma
    base = lf(r1 + 1) + lf(r2 + 1) + lf(c1 + 1) + lf(b + d + 1) - lf(r1 + r2 + 1)
    logp = lambda x: base - lf(x + 1) - lf(r1 - x + 1) - lf(c1 - x + 1) - lf(r2 - c1 + x + 1)
    here = logp(a)
    return min(1.0, sum(math.exp(logp(x)) for x in range(max(0, c1 - r2), min(r1, c1) + 1) if logp(x) <= here + 1e-7))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact_value(*map(int, t)) for t in zip(a, b, c, d)])


def conditional_odds_value(a: int, b: int, c: int, d: int, level: float = 0.95) -> tuple[float, float, float]:
    """Conditional maximum-likelihood odds ratio of a 2x2 table and its exact interval, from the noncentral hypergeometric
    distribution of a given the margins; 0 or infinity at the ends of a's range, nan where the margins fix a."""
    r1, r2, c1 = a + b, c + d, a + c
    low, high = max(0, c1 - r2), min(r1, c1)
    if low == high:
        return math.nan, 0.0, math.inf
    x = np.arange(low, high + 1, dtype=float)
    steps = np.log((r1 - x[:-1]) * (c1 - x[:-1])) - np.log((x[:-1] + 1) * (r2 - c1 + x[:-1] + 1))
    base = np.concatenate([[0.0], np.cumsum(steps)])

    def law(t: float) -> np.ndarray:
        w = base + t * x
        w = np.exp(w - w.max())
        return w / w.sum()

    def root(f) -> float:
        lo, hi = -1.0, 1.0
        while f(lo) > 0 and lo > -700:
            lo *= 2
        while f(hi) < 0 and hi < 700:
            hi *= 2
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        return math.exp((lo + hi) / 2)

    tail = (1 - level) / 2
    odds = 0.0 if a == low else math.inf if a == high else root(lambda t: law(t) @ x - a)
    lower = 0.0 if a == low else root(lambda t: law(t)[x >= a].sum() - tail)
    upper = math.inf if a == high else root(lambda t: tail - law(t)[x <= a].sum())
    return odds, lower, upper


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("odds", "low", "high")]))
def conditional_odds(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([conditional_odds_value(*map(int, t)) for t in zip(a, b, c, d)], columns=["odds", "low", "high"])
