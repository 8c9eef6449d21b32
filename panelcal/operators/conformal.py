"""Split, quantile-band and weighted conformal calibration.

A cell is any set of key columns (seed, model, domain, ...). Calibration is an exact order
statistic per cell; applying it is a join and a projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.functions.expressions import (
    band_conformity,
    clip,
    is_finite,
    rank_regime,
    requested_rank,
)
from panelcal.operators.ranks import (
    attach_first_at_or_above_bounded,
    first_at_or_above,
    order_statistics,
    running_totals,
)
from panelcal.schema import ContractError

ALPHAS = (0.05, 0.10)  # fixed values of the evaluation protocol
RAISE, INFINITE, CLAMP = "raise", "infinite", "legacy_max_clamp"


def calibrate(
    scores: DataFrame,
    by: Sequence[str],
    alphas: Sequence[float] = ALPHAS,
    *,
    score: str = "score",
    policy: str = RAISE,
    bounded_cells: bool = True,
) -> DataFrame:
    """Conformal quantile per cell and alpha with its rank diagnostics.

    The rank is ceil((n + 1)(1 - alpha)). When it exceeds n the policy decides: ``raise`` fails
    the job, ``infinite`` gives +inf without an effective rank, ``legacy_max_clamp`` takes the
    greatest score. The rank needs counts only, so an unattainable cell fails before any sort.
    ``bounded_cells`` is for cells that are a declared grid (seeds x models); see
    :func:`order_statistics`.
    """
    if policy not in (RAISE, INFINITE, CLAMP):
        raise ContractError(f"unknown policy: {policy}")
    if not alphas or any(not 0 < a < 1 for a in alphas):
        raise ContractError("alpha must lie strictly between 0 and 1")
    by = list(by)
    bad = ~is_finite(score) | (F.col(score) < 0)
    checked = scores.select(
        *by,
        F.when(bad, F.raise_error(F.lit("scores must be finite and nonnegative"))).otherwise(F.col(score).cast("double")).alias("quantile"),
    )
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    return _ranked(
        checked, by, by, lambda sizes: sizes.withColumn("alpha", F.explode(grid)), policy, bounded_cells=bounded_cells
    )


def _ranked(
    rows: DataFrame,
    groups: Sequence[str],
    by: Sequence[str],
    with_alpha: Callable[[DataFrame], DataFrame],
    policy: str,
    *,
    bounded_cells: bool,
) -> DataFrame:
    """Order statistic of ``quantile`` per group and alpha under an unattainable-rank policy."""

    def wanted(sizes: DataFrame) -> DataFrame:
        asked = with_alpha(sizes).withColumn("requested_rank", requested_rank("n", "alpha"))
        over = F.col("requested_rank") > F.col("n")
        if policy == RAISE:
            fail = F.raise_error(F.lit("requested conformal rank is unattainable"))
            rank = F.when(over, fail).otherwise(F.col("requested_rank"))
        elif policy == INFINITE:
            rank = F.when(~over, F.col("requested_rank"))
        else:
            rank = F.least(F.col("requested_rank"), F.col("n"))
        return asked.withColumn("rank", rank.cast("bigint"))

    found = order_statistics(
        rows, groups, "quantile", wanted, bounded_cells=bounded_cells, all_valid=policy != INFINITE
    )
    return found.select(
        *by,
        "alpha",
        F.coalesce(F.col("quantile"), F.lit(float("inf"))).alias("quantile"),
        F.col("n").alias("n_cal"),
        "requested_rank",
        F.col("rank").alias("effective_rank"),
        (F.col("requested_rank") <= F.col("n")).alias("finite_rank_attainable"),
        rank_regime("requested_rank", "n").alias("regime"),
        F.lit(policy).alias("unattainable_rank_policy"),
    )


def symmetric_intervals(
    predictions: DataFrame, quantiles: DataFrame, on: Sequence[str], *, center: str = "pred", bounded_cells: bool = True
) -> DataFrame:
    """Centre minus and plus the cell's quantile; the bounds are not clipped."""
    cells = quantiles.select(*on, "alpha", "quantile")
    joined = predictions.join(F.broadcast(cells) if bounded_cells else cells, list(on))
    return joined.withColumn("lower", F.col(center) - F.col("quantile")).withColumn(
        "upper", F.col(center) + F.col("quantile")
    )


def band_scores(rows: DataFrame, *, truth: str = "rul_capped", lower: str = "band_lower", upper: str = "band_upper") -> DataFrame:
    """Conformity of predicted bands; a crossed band fails the job."""
    value = F.when(F.col(lower) > F.col(upper), F.raise_error(F.lit("lower band above upper band"))).otherwise(
        band_conformity(truth, lower, upper)
    )
    return rows.withColumn("score", value)


def band_intervals(
    predictions: DataFrame,
    quantiles: DataFrame,
    on: Sequence[str],
    *,
    lower: str = "band_lower",
    upper: str = "band_upper",
    bounded_cells: bool = True,
) -> DataFrame:
    """Band widened by the cell's conformity quantile. ``on`` includes alpha: bands are per alpha."""
    cells = quantiles.select(*on, "quantile")
    joined = predictions.join(F.broadcast(cells) if bounded_cells else cells, list(on))
    return joined.withColumn("lower", F.col(lower) - F.col("quantile")).withColumn(
        "upper", F.col(upper) + F.col("quantile")
    )


def calibrate_bands(scores: DataFrame, by: Sequence[str], *, policy: str = RAISE) -> DataFrame:
    """Like :func:`calibrate` for scores that already carry their alpha among the keys."""
    keys = [c for c in by if c != "alpha"]
    if policy not in (RAISE, INFINITE, CLAMP):
        raise ContractError(f"unknown policy: {policy}")
    rows = scores.select(*keys, "alpha", F.greatest(F.col("score"), F.lit(0.0)).alias("quantile"))
    return _ranked(rows, [*keys, "alpha"], keys, lambda sizes: sizes, policy, bounded_cells=True)


# --- weighted calibration


def bounded_weights(
    calibration: DataFrame, target: DataFrame, by: Sequence[str], *, clip_min: float, clip_max: float, weight: str = "ratio"
) -> tuple[DataFrame, DataFrame]:
    """Calibration: clip, then divide by the clipped mean. Target: divide by that mean, then clip."""
    by = list(by)
    if not 0 < clip_min <= clip_max:
        raise ContractError("weight bounds must be positive and ordered")
    clipped = calibration.withColumn("weight", clip(weight, clip_min, clip_max))
    scale = clipped.groupBy(*by).agg(F.avg("weight").alias("_scale"))

    def scaled(rows: DataFrame) -> DataFrame:
        return rows.join(scale, by) if by else rows.crossJoin(scale)

    return (
        scaled(clipped).withColumn("weight", F.col("weight") / F.col("_scale")).drop("_scale"),
        scaled(target).withColumn("weight", clip(F.col(weight) / F.col("_scale"), clip_min, clip_max)).drop("_scale"),
    )


def cumulative_weights(scores: DataFrame, by: Sequence[str], *, slices: int | None = None) -> DataFrame:
    """Running calibration weight in score order, one step per distinct score."""
    return running_totals(scores.select(*by, "score", "weight"), by, "score", {"weight": "cum_weight"}, slices=slices)


def weighted_quantiles(
    scores: DataFrame,
    targets: DataFrame,
    by: Sequence[str],
    alphas: Sequence[float],
    *,
    bounded: bool = False,
    require_finite: bool = True,
    slices: int | None = None,
) -> DataFrame:
    """Pointwise weighted quantile: first score whose running weight reaches
    (1 - alpha)(total + own weight); +inf when none does.

    ``bounded`` says the weights are clipped: all thresholds of a cell then lie within
    (1 - alpha)(max - min weight) of each other, hence only a few steps can be answers, and they
    travel as one array. Otherwise the general as-of join runs.
    """
    by = list(by)
    steps = cumulative_weights(scores, by, slices=slices)
    totals = scores.groupBy(*by).agg(F.sum("weight").alias("_total"))
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    asked = (targets.join(totals, by) if by else targets.crossJoin(totals)).withColumn("alpha", F.explode(grid))
    asked = asked.withColumn("_t", (F.lit(1.0) - F.col("alpha")) * (F.col("_total") + F.col("weight"))).drop("_total")
    per_alpha = steps.withColumn("alpha", F.explode(grid)).select(*by, "alpha", "cum_weight", F.col("score").alias("quantile"))
    keys = [*by, "alpha"]
    if bounded:
        found = attach_first_at_or_above_bounded(asked, per_alpha, keys, "_t", "cum_weight", "quantile")
    else:
        found = first_at_or_above(asked, per_alpha, keys, "_t", "cum_weight", "quantile", slices=slices)
    missing = F.lit(float("inf"))
    if require_finite:
        missing = F.raise_error(F.lit("weighted conformal quantile is infinite")).cast("double")
    return found.withColumn("quantile", F.coalesce(F.col("quantile"), missing)).drop("_t")


def weight_diagnostics(calibration: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weight sum and effective sample size of the calibration side, range of the target side."""
    by = list(by)
    w = F.col("weight")
    cal = calibration.groupBy(*by).agg(
        F.sum(w).alias("calibration_weight_sum"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("calibration_effective_sample_size"),
    )
    tgt = target.groupBy(*by).agg(
        F.min(w).alias("target_weight_min"), F.max(w).alias("target_weight_max"), F.avg(w).alias("target_weight_mean")
    )
    return cal.join(tgt, by) if by else cal.crossJoin(tgt)


def quantile_diagnostics(rows: DataFrame, by: Sequence[str], *, order: str | None = None) -> DataFrame:
    """Range and distinct count of pointwise quantiles; with ``order`` also first, last and the
    fraction of unattainable ranks."""
    out = [
        F.min("quantile").alias("quantile_min"),
        F.max("quantile").alias("quantile_max"),
        F.count_distinct("quantile").alias("distinct_quantiles"),
    ]
    if order:
        out += [
            F.min_by("quantile", order).alias("initial_quantile"),
            F.max_by("quantile", order).alias("final_quantile"),
            F.avg((~F.col("finite_rank_attainable")).cast("int")).alias("unattainable_rank_fraction"),
        ]
    return rows.groupBy(*by).agg(*out)
