"""Cross-run tables: recompute, verify and summarise metrics over seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.functions.expressions import rank_regime, requested_rank
from panelcal.functions.expressions import is_finite
from panelcal.operators import metrics
from panelcal.operators.quality import differs
from panelcal.schema import ENTITY

PENDING = "pending"


def summarise(rows: DataFrame, keys: Sequence[str], *, sources: Sequence[str] = ("run_id",)) -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum over seeds.

    A group with any pending (null) value has pending statistics: the value is neither zero
    nor left out. Source identifiers are joined in sorted order; a group has one row per run.
    """
    complete = F.count("value") == F.count(F.lit(1))
    listed = [F.concat_ws("|", F.array_sort(F.collect_set(F.col(s).cast("string")))).alias(f"{s}s") for s in sources]
    return rows.groupBy(*keys).agg(
        F.when(complete, F.avg("value")).alias("mean"),
        F.when(complete & (F.count("value") > 1), F.stddev_samp("value")).alias("sample_std"),
        F.when(complete, F.min("value")).alias("minimum"),
        F.when(complete, F.max("value")).alias("maximum"),
        F.count_distinct("seed").alias("n_seeds"),
        F.count("value").alias("n_numeric_values"),
        F.when(complete, "numeric").otherwise(PENDING).alias("metric_status"),
        *listed,
    )


def rank_diagnostics(trace: DataFrame, keys: Sequence[str], *, policy: str) -> DataFrame:
    """Rank range, attainability and regimes of a cell.

    ``trace`` holds one row per endpoint with ``n_cal``, the alpha in use (``alpha_used``) and
    its quantile; for a fixed alpha all rows of a cell agree.
    """
    rank = requested_rank("n_cal", "alpha_used")
    rows = trace.withColumn("_rank", rank).withColumn("_effective", F.least(F.col("_rank"), F.col("n_cal")))
    fit = (F.col("_rank") <= F.col("n_cal")).cast("int")
    return rows.groupBy(*keys).agg(
        F.max("n_cal").alias("n_cal"),
        F.min("_rank").alias("requested_rank_min"),
        F.max("_rank").alias("requested_rank_max"),
        F.min("_effective").alias("effective_rank_min"),
        F.max("_effective").alias("effective_rank_max"),
        F.avg(fit).alias("finite_rank_attainable_fraction"),
        F.avg(1 - fit).alias("unattainable_rank_fraction"),
        F.concat_ws("|", F.array_sort(F.collect_set(rank_regime("_rank", "n_cal")))).alias("quantile_regime"),
        F.lit(policy).alias("unattainable_rank_policy"),
        F.count_distinct("quantile").alias("n_distinct_quantiles"),
    )


def weighted_rank_diagnostics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pointwise weighted quantiles have no integer rank: those fields stay pending (null).

    The two status texts are fixed values of the report format.
    """
    none = F.lit(None)
    return rows.groupBy(*keys).agg(
        F.max("n_cal").alias("n_cal"),
        *[none.cast("bigint").alias(f"{k}_rank_{e}") for k in ("requested", "effective") for e in ("min", "max")],
        none.cast("double").alias("finite_rank_attainable_fraction"),
        none.cast("double").alias("unattainable_rank_fraction"),
        F.lit("weighted_pointwise_not_integer_ranked").alias("quantile_regime"),
        F.lit("not_applicable_to_weighted_quantile").alias("unattainable_rank_policy"),
        F.count_distinct("quantile").alias("n_distinct_quantiles"),
    )


def point_rows(predictions: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Point metrics per cell and variant, long, with status."""
    keys = [*cell, "prediction_variant"]
    found = metrics.point_metrics(metrics.point_variants(predictions, cell), keys)
    return metrics.metrics_long(found, keys, metrics.POINT_METRICS, status="metric_status")


def interval_rows(
    intervals: DataFrame, cell: Sequence[str], *, scale: float | str, resamples: int, confidence: float = 0.95, mode: str = "poisson"
) -> DataFrame:
    """Interval metrics per cell and alpha with bootstrap bounds, long."""
    keys = [*cell, "alpha"]
    found = metrics.interval_metrics(intervals, cell, scale=scale)
    # An unattainable cell keeps its rows, as pending ones.
    known = is_finite("mean_width")
    found = found.select(*keys, "n_endpoints", *[F.when(known, F.col(m)).alias(m) for m in metrics.INTERVAL_METRICS], F.lit(metrics.PENDING).alias("_state"))
    long = metrics.metrics_long(found, keys, metrics.INTERVAL_METRICS, status="_state")
    bounds = metrics.bootstrap_intervals(
        intervals, cell, scale=scale, resamples=resamples, confidence=confidence, mode=mode
    )
    return long.join(bounds, [*keys, "metric"]).withColumns(
        {
            "bootstrap_resamples": F.lit(resamples),
            "bootstrap_confidence_level": F.lit(confidence),
            "target_scale": F.lit(None if isinstance(scale, str) else float(scale)).cast("double"),
        }
    )


def run_rows(runs: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One provenance row per run with its number of endpoint entities."""
    counts = predictions.groupBy(*keys).agg(F.count_distinct(ENTITY).alias("endpoint_rows"))
    return runs.join(counts, list(keys), "left").withColumn("endpoint_rows", F.coalesce("endpoint_rows", F.lit(0)))


def calibration_sizes(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count_distinct(ENTITY).alias("n_cal"))


def verify_stored(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored metric values against recomputed ones; keys on one side only count as differing."""
    both = stored.select(*keys, F.col("value").alias("_stored")).join(
        recomputed.select(*keys, F.col("value").alias("_again")), list(keys), "full_outer"
    )
    one_sided = F.col("_stored").isNull() != F.col("_again").isNull()
    bad = one_sided | F.coalesce(differs(F.col("_stored"), F.col("_again")), F.lit(False))
    return both.select(*keys, F.col("_stored").alias("stored"), F.col("_again").alias("value"), (~bad).alias("stored_metric_match"))


def count_contract(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Row counts of report tables against their contract."""
    out = None
    for name, want in expected.items():
        part = tables[name].agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(want).cast("bigint").alias("expected")
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ok", F.col("rows") == F.col("expected"))
