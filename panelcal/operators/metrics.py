"""Point and interval metrics per cell, with entity bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcal.functions.expressions import asymmetric_penalty, covered, interval_score, is_finite, uniform
from panelcal.operators.ranks import distributed_rank
from panelcal.schema import ENTITY, ContractError, require
from panelcal.session import stored

NONFINITE = "nonfinite_on_raw_support"
PENDING = "pending"
POINT_METRICS = ("rmse", "mae", "signed_error", "nasa_score")
INTERVAL_METRICS = ("coverage", "mean_width", "normalized_interval_score")
#: Multinomial draws: consecutive numbers of one resample that are drawn together, draws of a task, and rows that the draws may meet by broadcast.
DRAW_BLOCK, DRAWS_PER_TASK, BROADCAST_ROWS = 1 << 16, 2_000_000, 250_000


def point_metrics(rows: DataFrame, cell: Sequence[str], *, truth: str = "y_true", prediction: str = "pred") -> DataFrame:
    """RMSE, MAE, mean signed error (prediction minus truth) and the summed asymmetric penalty.

    An overflowing penalty sum is reported as null with a status, never dropped.
    """
    d = F.col(prediction) - F.col(truth).cast("double")
    found = rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_endpoints"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"),
        F.avg(d).alias("signed_error"),
        F.sum(asymmetric_penalty(d)).alias("_penalty"),
    )
    finite = F.abs(F.col("_penalty")) < F.lit(float("inf"))
    return found.select(
        *cell,
        "n_endpoints",
        "rmse",
        "mae",
        "signed_error",
        F.when(finite, F.col("_penalty")).alias("nasa_score"),
        F.when(finite, "numeric").otherwise(NONFINITE).alias("metric_status"),
    )


def evaluate_endpoints(rows: DataFrame, cell: Sequence[str], **columns: str) -> DataFrame:
    """Point metrics of a table that must hold one row per entity and cell."""
    require(rows, [*cell, ENTITY])
    per_entity = rows.groupBy(*cell, ENTITY).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(columns.get(k, d)).alias(columns.get(k, d)) for k, d in (("truth", "y_true"), ("prediction", "pred"))]
    )
    truth = columns.get("truth", "y_true")
    guarded = per_entity.withColumn(
        truth,
        F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row per entity"))).otherwise(F.col(truth)),
    )
    return point_metrics(guarded, cell, truth=truth, prediction=columns.get("prediction", "pred"))


def point_variants(rows: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Each prediction row twice: raw against raw truth, and clipped against capped truth."""
    variants = F.array(
        F.struct(F.lit("clipped").alias("prediction_variant"), F.col("y_true").cast("double").alias("truth"), F.col("pred").alias("value")),
        F.struct(F.lit("raw").alias("prediction_variant"), F.col("y_true_raw").cast("double").alias("truth"), F.col("pred_raw").alias("value")),
    )
    return rows.select(*cell, F.explode(variants).alias("_v")).select(
        *cell, "_v.prediction_variant", F.col("_v.truth").alias("y_true"), F.col("_v.value").alias("pred")
    )


def _scale(scale: float | str) -> Column:
    """A number, or the column that holds each row's scale."""
    if isinstance(scale, str):
        value = F.col(scale).cast("double")
        return F.when(value > 0, value).otherwise(F.raise_error(F.lit("the target scale must be positive")))
    if scale <= 0:
        raise ContractError("the target scale must be positive")
    return F.lit(float(scale))


def _measures(truth: str, lower: str, upper: str, alpha: str | float, scale: float | str) -> dict[str, Column]:
    return {
        "coverage": covered(truth, lower, upper).cast("double"),
        "mean_width": F.col(upper) - F.col(lower),
        "normalized_interval_score": interval_score(truth, lower, upper, alpha) / _scale(scale),
    }


def interval_metrics(
    rows: DataFrame,
    cell: Sequence[str],
    *,
    scale: float | str,
    truth: str = "y_true",
    lower: str = "lower",
    upper: str = "upper",
    alpha: str = "alpha",
) -> DataFrame:
    """Coverage (closed bounds), mean width, and mean interval score over ``scale`` (a number or a column)."""
    keys = list(cell) if alpha in cell else [*cell, alpha]
    m = _measures(truth, lower, upper, alpha, scale)
    guard = F.when(F.col(lower) > F.col(upper), F.raise_error(F.lit("lower bound above upper bound"))).otherwise(m["coverage"])
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_endpoints"),
        F.avg(guard).alias("coverage"),
        F.avg(m["mean_width"]).alias("mean_width"),
        F.avg(m["normalized_interval_score"]).alias("normalized_interval_score"),
    )


def metrics_long(metrics: DataFrame, cell: Sequence[str], names: Sequence[str], status: str | None = None) -> DataFrame:
    """Wide metrics to rows (metric, value, metric_status)."""
    state = F.col(status) if status else F.lit("numeric")
    pairs = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).cast("double").alias("value"),
                (F.when(F.col(m).isNull(), state).otherwise(F.lit("numeric"))).alias("metric_status"),
            )
            for m in names
        ]
    )
    keep = [*cell, "n_endpoints"] if "n_endpoints" in metrics.columns else list(cell)
    return metrics.select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.*")


def _poisson_weight(u: Column) -> Column:
    """Poisson(1) by inversion: the number of cumulative probabilities at or below ``u``."""
    total, mass, steps = 0.0, math.exp(-1.0), []
    for k in range(1, 20):  # what lies beyond has less than 2^-52
        total += mass
        steps.append(F.when(u >= F.lit(total), 1).otherwise(0))
        mass /= k
    out = steps[0]
    for step in steps[1:]:
        out = out + step
    return out


def bootstrap_intervals(
    rows: DataFrame,
    cell: Sequence[str],
    *,
    scale: float | str,
    seed: str | int = "seed",
    resamples: int = 2000,
    confidence: float = 0.95,
    mode: str = "multinomial",
    truth: str = "y_true",
    lower: str = "lower",
    upper: str = "upper",
    alpha: str = "alpha",
    entity: Sequence[str] = (ENTITY,),
) -> DataFrame:
    """Percentile bootstrap over entities for the three interval metrics.

    ``multinomial`` draws n rows per resample: each (cell, resample, draw) hashes to a row
    number, and an equi-join on it fetches the row; the draws stay where they are made or are merged, never broadcast. ``poisson`` gives every (row, resample) a
    Poisson(1) weight instead: the same limit, and only per-resample sums are shuffled, which
    is the mode for cells of many millions of entities.

    A cell with an unbounded interval (an unattainable rank) has no bounds: its rows stay, with nulls and
    ``bootstrap_status`` pending.
    """
    if resamples < 1 or not 0 < confidence < 1:
        raise ContractError("invalid bootstrap parameters")
    keys = list(cell) if alpha in cell else [*cell, alpha]
    m = _measures(truth, lower, upper, alpha, scale)
    seed_col = F.col(seed) if isinstance(seed, str) else F.lit(seed)
    base = rows.select(*keys, *entity, seed_col.alias("_seed"), *[c.alias(f"_{n}") for n, c in m.items()])
    names = list(m)
    metric = F.explode(F.array(*[F.lit(n) for n in names])).alias("metric")
    bounded = is_finite("_mean_width")
    cells = base.groupBy(*keys).agg(F.every(bounded).alias("_bounded")).select(*keys, "_bounded", metric)
    base = base.filter(bounded)
    draws = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))
    if mode == "poisson":
        # The hash is a column of its own, so that its thirteen uses do not repeat it.
        drawn = base.withColumn("_b", draws).withColumn("_u", uniform("_seed", "_b", *entity))
        weighted = drawn.withColumn("_w", _poisson_weight(F.col("_u")))
        total = F.nullif(F.sum("_w"), F.lit(0))
        samples = weighted.groupBy(*keys, "_b").agg(
            *[(F.sum(F.col(f"_{n}") * F.col("_w")) / total).alias(n) for n in names]
        )
    elif mode == "multinomial":
        if len(entity) != 1:
            raise ContractError("multinomial draws need one entity column")
        base = stored(base, "bootstrap-rows")
        ordered = stored(distributed_rank(base, keys, entity[0], [], out="_at").drop("_seed", *entity), "bootstrap-ranked")
        sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first("_seed").alias("_seed"))
        rows_n = ordered.count()
        # Draws are made in blocks, dealt over tasks by their number, which Spark cannot see before they are made.
        picks = (
            sizes.withColumn("_b", draws)
            .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / DRAW_BLOCK))))
            .repartition(1 + rows_n * resamples // DRAWS_PER_TASK, *keys, "_b", "_block")
            .withColumn("_j", F.explode(F.sequence(F.col("_block") * DRAW_BLOCK, F.least((F.col("_block") + 1) * DRAW_BLOCK, F.col("_n")) - 1)))
            .withColumn("_at", F.floor(uniform("_seed", "_b", "_j") * F.col("_n")).cast("bigint") + 1)
            .select(*keys, "_b", "_at")
        )
        # The draws look as small as the cells they come from and must never be broadcast; the rows may be, behind their count.
        drawn = picks.join(F.broadcast(ordered), [*keys, "_at"]) if rows_n <= BROADCAST_ROWS else picks.hint("merge").join(ordered, [*keys, "_at"])
        samples = drawn.groupBy(*keys, "_b").agg(*[F.avg(f"_{n}").alias(n) for n in names])
    else:
        raise ContractError(f"unknown bootstrap mode: {mode}")
    tail = (1.0 - confidence) / 2.0
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])
    long = samples.select(*keys, F.explode(pairs).alias("_m")).select(*keys, "_m.*")
    found = long.groupBy(*keys, "metric").agg(
        F.expr(f"percentile(v, {tail}D)").alias("bootstrap_ci_lower"),
        F.expr(f"percentile(v, {1.0 - tail}D)").alias("bootstrap_ci_upper"),
    )
    return cells.join(found, [*keys, "metric"], "left").select(
        *keys,
        "metric",
        F.when(F.col("_bounded"), F.col("bootstrap_ci_lower")).alias("bootstrap_ci_lower"),
        F.when(F.col("_bounded"), F.col("bootstrap_ci_upper")).alias("bootstrap_ci_upper"),
        F.when(F.col("_bounded"), "numeric").otherwise(PENDING).alias("bootstrap_status"),
    )
