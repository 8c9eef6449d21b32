"""Factorials, binomials and Beta integrals of integer parameters as column expressions.

Spark SQL has no lgamma. All parameters in the audit are integers, so ln(n!) is enough:
a table built from a rule below 256 and the Stirling series above it. The incomplete Beta integral
and its inverse are vectorised functions of Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcal.functions.expressions import col

#: Terms of the continued fraction and steps of its inverse at most.
TERMS, STEPS = 20_000, 200
_TABLE_SIZE = 256
# One foldable text instead of 256 literal nodes in every expression that uses the table.
_TABLE = "cast(split('" + ",".join(repr(math.lgamma(i + 1.0)) for i in range(_TABLE_SIZE)) + "', ',') as array<double>)"


def ln_factorial(n: Column | str) -> Column:
    """ln(n!) for a non-negative integer column."""
    k = col(n).cast("bigint")
    table = F.expr(_TABLE)
    x = k.cast("double") + F.lit(1.0)
    series = (
        (x - 0.5) * F.log(x)
        - x
        + F.lit(0.5 * math.log(2.0 * math.pi))
        + F.lit(1.0) / (x * 12.0)
        - F.lit(1.0) / (x * x * x * 360.0)
        + F.lit(1.0) / (x * x * x * x * x * 1260.0)
    )
    return F.when(k < _TABLE_SIZE, F.element_at(table, F.least(k, F.lit(_TABLE_SIZE - 1)).cast("int") + 1)).otherwise(
        series
    )


def _ln_ratio(top: list[Column], bottom: list[Column]) -> Column:
    """ln of a ratio of factorials, as one fold so that the series appears once in the plan."""
    terms = [F.struct(c.cast("bigint").alias("n"), F.lit(1.0).alias("sign")) for c in top]
    terms += [F.struct(c.cast("bigint").alias("n"), F.lit(-1.0).alias("sign")) for c in bottom]
    return F.aggregate(F.array(*terms), F.lit(0.0), lambda acc, t: acc + t["sign"] * ln_factorial(t["n"]))


def ln_choose(n: Column | str, k: Column | str) -> Column:
    top, pick = col(n), col(k)
    return _ln_ratio([top], [pick, top - pick])


def ln_beta(a: Column | str, b: Column | str) -> Column:
    """ln B(a, b) for positive integers."""
    p, q = col(a), col(b)
    return _ln_ratio([p - 1, q - 1], [p + q - 1])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the Beta integral, for x below its mean, term by term until no row changes.

    It takes a multiple of the square root of the parameters; more than ``TERMS`` terms are an error.
    """

    def off_zero(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < 1e-300, 1e-300, v)

    c, d = np.ones_like(x), 1.0 / off_zero(1.0 - (a + b) * x / (a + 1.0))
    out = d
    for m in range(1, TERMS + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for term in (even, odd):
            d = 1.0 / off_zero(1.0 + term * d)
            c = off_zero(1.0 + term / c)
            factor = c * d
            out = out * factor
        if not (np.abs(factor - 1.0) > 4e-16).any():
            return out
    raise ArithmeticError("the Beta integral did not settle")


def regularised_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """I_x(a, b) of positive parameters."""
    inside = (x > 0) & (x < 1)
    out = np.where(x >= 1, 1.0, np.where(x <= 0, 0.0, np.nan))
    if inside.any():
        p, q, v = a[inside], b[inside], x[inside]
        log_beta = np.array([math.lgamma(i) + math.lgamma(j) - math.lgamma(i + j) for i, j in zip(p, q, strict=True)])
        front = np.exp(p * np.log(v) + q * np.log1p(-v) - log_beta)
        # The fraction is short on the side of the mean where the tail is.
        turned = v > (p + 1.0) / (p + q + 2.0)
        first, second, at = np.where(turned, q, p), np.where(turned, p, q), np.where(turned, 1.0 - v, v)
        tail = front * _fraction(first, second, at) / first
        out[inside] = np.clip(np.where(turned, 1.0 - tail, tail), 0.0, 1.0)
    return out


def inverse_beta(probability: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with I_x(a, b) = probability: Newton steps, halving where a step leaves the bracket."""
    low, high, x = np.zeros_like(a), np.ones_like(a), a / (a + b)
    log_beta = np.array([math.lgamma(i) + math.lgamma(j) - math.lgamma(i + j) for i, j in zip(a, b, strict=True)])
    for _ in range(STEPS):
        gap = regularised_beta(x, a, b) - probability
        low, high = np.where(gap < 0, x, low), np.where(gap < 0, high, x)
        density = np.exp((a - 1.0) * np.log(x) + (b - 1.0) * np.log1p(-x) - log_beta)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = x - gap / density
        following = np.where((step > low) & (step < high), step, (low + high) / 2.0)
        settled = np.abs(following - x) <= 1e-16
        x = np.clip(following, 1e-300, 1.0 - 1e-16)
        if settled.all():
            break
    return np.where(probability <= 0, 0.0, np.where(probability >= 1, 1.0, x))


def _known(function, *columns: pd.Series) -> pd.Series:
    """A function of arrays on the rows that have all values; null on the others."""
    values = [c.to_numpy("float64", na_value=np.nan) for c in columns]
    out = np.full(len(values[0]), np.nan)
    held = ~np.isnan(values).any(axis=0)
    if held.any():
        out[held] = function(*[v[held] for v in values])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _known(regularised_beta, x, a, b)


@F.pandas_udf(T.DoubleType())
def _quantile(probability: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return _known(inverse_beta, probability, a, b)


def beta_cdf(x: Column | str, a: Column | str, b: Column | str) -> Column:
    """I_x(a, b), by a continued fraction whose length does not follow the size of the calibration set."""
    return _cdf(*[col(c).cast("double") for c in (x, a, b)])


def beta_quantile(probability: Column | str, a: Column | str, b: Column | str) -> Column:
    """Inverse of :func:`beta_cdf`."""
    return _quantile(*[col(c).cast("double") for c in (probability, a, b)])


def beta_mean(a: Column | str, b: Column | str) -> Column:
    p, q = col(a).cast("double"), col(b).cast("double")
    return p / (p + q)


def beta_sd(a: Column | str, b: Column | str) -> Column:
    p, q = col(a).cast("double"), col(b).cast("double")
    return F.sqrt(p * q / ((p + q) * (p + q) * (p + q + 1.0)))


def beta_cdf_integral(x: Column | str, a: Column | str, b: Column | str) -> Column:
    """Antiderivative of the Beta CDF: x I_x(a, b) - a / (a + b) I_x(a + 1, b)."""
    p = col(a).cast("bigint")
    return col(x) * beta_cdf(x, p, b) - beta_mean(p, b) * beta_cdf(x, p + F.lit(1), b)
