"""Scalar column expressions used by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the interval protocol.
RUL_CAP = 125
ASYMMETRIC_EARLY_SCALE = 13.0
ASYMMETRIC_LATE_SCALE = 10.0
SEVERE_MARGIN = 0.10
INTERIOR = "interior"
MAX_STATISTIC = "max_statistic"
UNATTAINABLE = "finite_quantile_unattainable"


def col(value: Column | str | float | int) -> Column:
    """Name -> column, number -> literal, column -> itself."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def is_finite(value: Column | str) -> Column:
    """True only for a non-null, non-NaN, non-infinite number (NaN > x is true in Spark)."""
    c = col(value)
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < F.lit(float("inf")))


def clip(value: Column | str, low: float, high: float | Column) -> Column:
    return F.greatest(F.lit(low), F.least(col(value), col(high)))


# --- hash randomness: a pure function of its key, so no order or partition can change it


def hash_bits(*parts: Column | str | int, digits: int = 15) -> Column:
    """Unsigned integer from the first ``digits`` hex digits of md5 over ':'-joined parts."""
    key = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("bigint")


def uniform_int(low: Column, high: Column, *key: Column | str | int) -> Column:
    """Integer in [low, high] chosen by the hash of ``key``."""
    return low + F.pmod(hash_bits(*key, digits=8), high - low + F.lit(1))


def uniform(*key: Column | str | int) -> Column:
    """Double in [0, 1) chosen by 52 bits of the hash of ``key``."""
    return hash_bits(*key, digits=13) / F.lit(float(1 << 52))


# --- conformal pieces


def requested_rank(n: Column | str, alpha: Column | str | float) -> Column:
    """ceil((n + 1) * (1 - alpha)), in DOUBLE and in this order of operations."""
    return F.ceil((col(n).cast("double") + F.lit(1.0)) * (F.lit(1.0) - col(alpha).cast("double")))


def rank_regime(rank: Column | str, n: Column | str) -> Column:
    r, size = col(rank), col(n)
    return F.when(r < size, INTERIOR).when(r == size, MAX_STATISTIC).otherwise(UNATTAINABLE)


def absolute_residual(truth: Column | str, prediction: Column | str) -> Column:
    return F.abs(col(truth).cast("double") - col(prediction))


def band_conformity(truth: Column | str, lower: Column | str, upper: Column | str) -> Column:
    """How far the truth lies outside a predicted band, 0 inside it."""
    y = col(truth).cast("double")
    return F.greatest(col(lower) - y, y - col(upper), F.lit(0.0))


def covered(truth: Column | str, lower: Column | str, upper: Column | str) -> Column:
    """Closed bounds."""
    y = col(truth)
    return (y >= col(lower)) & (y <= col(upper))


def interval_score(
    truth: Column | str, lower: Column | str, upper: Column | str, alpha: Column | str | float
) -> Column:
    y, lo, hi = col(truth), col(lower), col(upper)
    outside = F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0))
    return (hi - lo) + (F.lit(2.0) / col(alpha)) * outside


def asymmetric_penalty(error: Column | str) -> Column:
    """Late predictions (positive error) cost more than early ones."""
    d = col(error)
    early = F.exp(-d / F.lit(ASYMMETRIC_EARLY_SCALE)) - F.lit(1.0)
    late = F.exp(d / F.lit(ASYMMETRIC_LATE_SCALE)) - F.lit(1.0)
    return F.when(d < 0, early).otherwise(late)


def severe_threshold(alpha: Column | str | float) -> Column:
    """Coverage strictly below this counts as severe undercoverage."""
    return (F.lit(1.0) - col(alpha)) - F.lit(SEVERE_MARGIN)


def density_odds(probability: Column | str, n_source: Column, n_target: Column) -> Column:
    """Target/source density ratio from a class probability, corrected by the class sizes."""
    p = col(probability)
    top = F.greatest(F.lit(1e-8), F.least(p, F.lit(1.0 - 1e-8)))
    bottom = F.greatest(F.lit(1e-8), F.least(F.lit(1.0) - p, F.lit(1.0)))
    return top / bottom * (n_source.cast("double") / n_target.cast("double"))


def cell_key(n: Column | str, alpha: Column | str) -> Column:
    """Display key of an audit cell, such as ``n10_alpha_0.1``."""
    return F.concat(F.lit("n"), col(n).cast("string"), F.lit("_alpha_"), col(alpha).cast("string"))
