"""Composite workloads in long form: every seed, condition, domain, model and alpha is a key.

Point predictions come from a *predictor*: a function of the training rows and the endpoint
rows that returns the endpoint rows once per model with ``model`` and ``pred_raw``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcal.functions.expressions import RUL_CAP, clip
from panelcal.operators import adaptive, conformal, models, reporting, reservoir, split, weights
from panelcal.operators.features import WINDOWS, feature_names, kept_sensors, sensor_variances, temporal_features
from panelcal.operators.labels import endpoints_at, last_cycles, score_endpoints
from panelcal.operators.regimes import RegimeScaler, RegimeScaling, RegimeScalingModel, scale_by_regime
from panelcal.schema import CYCLE, ENTITY, SETTINGS
from panelcal.session import scratch_path, stored

CELL = ["seed", "condition", "model"]


@dataclass(frozen=True)
class Design:
    """Declared grid of a run set."""

    seeds: tuple[int, ...] = split.SEEDS
    conditions: tuple[tuple, ...] = split.CONDITIONS[:1]
    alphas: tuple[float, ...] = conformal.ALPHAS
    policy: str = conformal.RAISE
    resamples: int = 2000
    confidence: float = 0.95
    bootstrap: str = "poisson"
    domains: tuple[str, ...] = ()

    @property
    def scale(self) -> str:
        """Interval scores are divided by the cap of their own condition."""
        return "cap"


@dataclass
class Endpoints:
    """Role assignment, cuts and the endpoint rows of a design, each written once, and the panel that the rows are of."""

    roles: DataFrame
    cuts: DataFrame
    rows: DataFrame
    design: Design = field(default_factory=Design)
    panel: DataFrame | None = None


def grid_table(panel: DataFrame, design: Design) -> DataFrame:
    spark = panel.sparkSession
    return split.condition_table(spark, design.conditions).crossJoin(split.seed_table(spark, design.seeds))


def entity_lives(panel: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return last_cycles(panel, [*keep, ENTITY])


def rows_in_reach(panel: DataFrame, cuts: DataFrame, roles: DataFrame, *, source: Column | None = None, depth: int = max(WINDOWS)) -> DataFrame:
    """The rows that a fit or the windows of an endpoint read: all of an entity that is trained on, of others the ``depth`` up to each cut.

    Where an entity's cycles have gaps, all its rows up to its last cut stay.
    """
    here = source if source is not None else F.lit(True)
    trained = roles.filter(F.col("role") == split.TRAIN).select(ENTITY).distinct().withColumn("_fit", F.lit(True))
    reach = panel.groupBy(ENTITY).agg(
        F.max(here).alias("_here"), ((F.count(F.lit(1)) == F.max(CYCLE)) & (F.min(CYCLE) == 1)).alias("_whole")
    )
    ends = cuts.groupBy(ENTITY).agg(F.collect_set("cut").alias("_cuts"))
    reach = reach.join(trained, ENTITY, "left").join(ends, ENTITY, "left")
    fits = F.col("_here") & F.col("_fit").isNotNull()
    near = F.exists("_cuts", lambda c: (F.col(CYCLE) <= c) & (~F.col("_whole") | (F.col(CYCLE) > c - F.lit(depth))))
    wanted = fits | F.coalesce(near, F.lit(False))
    return panel.join(stored(reach, "reach"), ENTITY).filter(wanted).select(*panel.columns)


def prepare_endpoints(
    panel: DataFrame,
    design: Design,
    *,
    keep: Sequence[str] = (),
    source: Column | None = None,
    name: str = "design",
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> Endpoints:
    """Roles, cuts and prefix endpoints of every held-out entity.

    Entities outside ``source`` (a condition on the columns of ``keep``) are never trained on, so all of
    them are held out, as validation entities.

    ``panel`` carries ``next_cycle``. Truth is the full trajectory's remaining life, whatever
    the prefix shows. ``keep`` are per-entity columns (a domain) to carry along. ``derive`` makes the features, and ``next_cycle``,
    of a panel that has none yet; it is given the rows in reach of a fit or an endpoint.
    """
    lives = stored(entity_lives(panel, keep), f"{name}-lives")
    roles = stored(split.assign_roles(lives, design.seeds), f"{name}-roles")
    here = F.coalesce(source, F.lit(False)) if source is not None else F.lit(True)
    cuts = (
        split.cut_points(lives.select(ENTITY, "last_cycle"), grid_table(panel, design))
        .join(roles, ["seed", ENTITY])
        .join(lives, ENTITY)
        .withColumn("role", F.when(here, F.col("role")).otherwise(split.VALIDATION))
        .filter(F.col("role") != split.TRAIN)
    )
    cuts = stored(cuts, f"{name}-cuts")
    if derive is not None:
        panel = derive(rows_in_reach(panel, cuts, roles, source=source))
    inputs = panel.drop(*keep)
    rows = endpoints_at(inputs, cuts).withColumn("rul_raw", F.col("last_cycle") - F.col(CYCLE))
    rows = rows.withColumn("rul_capped", F.least(F.col("rul_raw"), F.col("cap").cast("bigint")))
    return Endpoints(roles, cuts, rows.drop("next_cycle", "last_cycle", "cut"), design, panel)


def training_rows(panel: DataFrame, roles: DataFrame, lives: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows of training entities per seed and condition with their labels."""
    train = roles.filter(F.col("role") == split.TRAIN).select("seed", ENTITY)
    caps = grid.select("seed", "condition", "cap").distinct()
    return (
        panel.join(lives, ENTITY)
        .join(train, ENTITY)
        .join(F.broadcast(caps), "seed")
        .withColumn("rul_raw", F.col("last_cycle") - F.col(CYCLE))
        .withColumn("rul_capped", F.least(F.col("rul_raw"), F.col("cap").cast("bigint")))
        .drop("last_cycle")
    )


# --- predictors


def progress_means(train: DataFrame, bucket: Column, keys: Sequence[str] = ("seed", "condition")) -> tuple[DataFrame, DataFrame]:
    """Mean capped label overall and per progress bucket, from one partial aggregate."""
    sums = train.groupBy(*keys, bucket.alias("bucket")).agg(
        F.sum(F.col("rul_capped").cast("double")).alias("_s"), F.count(F.lit(1)).alias("_c")
    )
    overall = sums.groupBy(*keys).agg((F.sum("_s") / F.sum("_c")).alias("overall"))
    return sums.select(*keys, "bucket", (F.col("_s") / F.col("_c")).alias("bucket_mean")), overall


def progress_predictor(width: int = 10) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Two baselines without a fit job: the training mean, and the mean per cycle bucket."""
    bucket = F.floor(F.col(CYCLE) / F.lit(width)).cast("bigint")

    def predict(train: DataFrame, rows: DataFrame) -> DataFrame:
        by_bucket, overall = progress_means(train, bucket)
        joined = (
            rows.withColumn("bucket", bucket)
            .join(overall, ["seed", "condition"])
            .join(by_bucket, ["seed", "condition", "bucket"], "left")
        )
        both = F.array(
            F.struct(F.lit("mean").alias("model"), F.col("overall").alias("pred_raw")),
            F.struct(F.lit("cycle_mean").alias("model"), F.coalesce("bucket_mean", "overall").alias("pred_raw")),
        )
        return joined.select(*rows.columns, F.explode(both).alias("_m")).select(*rows.columns, "_m.*")

    return predict


def model_predictor(
    features: Sequence[str], *, boosting: dict | None = None, only: Sequence[str] = models.POINT_MODELS
) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The point models, fitted once per declared seed and condition on training entities."""

    def predict(train: DataFrame, rows: DataFrame) -> DataFrame:
        out = None
        cells = [(r.seed, r.condition) for r in train.select("seed", "condition").distinct().collect()]
        for seed, condition in sorted(cells):
            here = (F.col("seed") == seed) & (F.col("condition") == condition)
            fit_on = stored(train.filter(here).select(*features, "rul_capped"), "training-rows")
            fitted = []
            if "mean" in only:
                fitted.append(models.fit_mean(fit_on))
            if "ridge" in only:
                fitted.append(models.fit_ridge(fit_on, features))
            if "hist_gradient_boosting" in only:
                fitted.append(models.fit_boosting(fit_on, features, seed=int(seed), **(boosting or {})))
            part = models.predict_long(fitted, rows.filter(here), rows.columns)
            out = part if out is None else out.unionByName(part)
        return out

    return predict


def scored_predictions(
    panel: DataFrame,
    design: Design,
    predictor: Callable[[DataFrame, DataFrame], DataFrame],
    *,
    keep: Sequence[str] = (),
    train_filter: Column | None = None,
    name: str = "design",
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Fit on training entities, predict the endpoints of all others, clip and score.

    ``train_filter`` restricts the entities that are trained on and calibrated with (a source
    domain); the fit is not repeated for the others, all of which are evaluated. Written once.
    """
    ends = prepare_endpoints(panel, design, keep=keep, source=train_filter, name=name, derive=derive)
    life = entity_lives(panel)
    base = ends.panel.filter(train_filter) if train_filter is not None else ends.panel
    train = training_rows(base.drop(*keep, "next_cycle"), ends.roles, life, grid_table(panel, design))
    predicted = predictor(train, ends.rows)
    scored = predicted.withColumn("pred", clip("pred_raw", 0.0, F.col("cap").cast("double"))).withColumn(
        "score", F.abs(F.col("rul_capped").cast("double") - F.col("pred"))
    )
    out = scored.withColumn("y_true_raw", F.col("rul_raw").cast("double")).withColumn(
        "y_true", F.col("rul_capped").cast("double")
    )
    columns = [
        "seed", "condition", "cap", *keep, "role", ENTITY, CYCLE, "rul_raw", "rul_capped",
        *[s for s in SETTINGS if s in out.columns], "model", "pred_raw", "pred", "score", "y_true_raw", "y_true",
    ]
    return stored(out.select(*columns), f"{name}-predictions")


def split_conformal(predictions: DataFrame, design: Design, *, source: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Quantiles per (seed, condition, model, alpha), and intervals for the validation rows."""
    calibration = predictions.filter(F.col("role") == split.CALIBRATION)
    if source is not None:
        calibration = calibration.filter(source)
    quantiles = conformal.calibrate(calibration, CELL, design.alphas, policy=design.policy)
    validation = predictions.filter(F.col("role") == split.VALIDATION)
    return quantiles, conformal.symmetric_intervals(validation, quantiles, CELL)


def interval_report(intervals: DataFrame, design: Design, cell: Sequence[str]) -> DataFrame:
    """Interval metrics per cell and alpha with bootstrap bounds, long."""
    return reporting.interval_rows(
        intervals, cell, scale=design.scale, resamples=design.resamples, confidence=design.confidence, mode=design.bootstrap
    )


def shift_matrix(
    panel: DataFrame, design: Design, predictor, source: Column, *, name: str = "shift", derive: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Fit and calibrate on one domain, evaluate on every domain without refitting."""
    predictions = scored_predictions(panel, design, predictor, keep=["domain"], train_filter=source, name=name, derive=derive)
    _, intervals = split_conformal(predictions, design, source=source)
    return intervals


def weighted_conformal(
    predictions: DataFrame, design: Design, source: Column, *, clip_min: float = weights.CLIP_MIN, clip_max: float = weights.CLIP_MAX
) -> tuple[DataFrame, DataFrame]:
    """Density-ratio weighted intervals per target domain from the source's calibration scores.

    Returns the intervals and the weight diagnostics. One logistic fit per seed and domain.
    """
    intervals, diagnostics = None, None
    one_model = predictions.select("model").first()[0]
    for seed in design.seeds:
        for domain in design.domains:
            rows = predictions.filter(F.col("seed") == seed)
            cal = rows.filter(source & (F.col("role") == split.CALIBRATION))
            tgt = rows.filter((F.col("domain") == domain) & (F.col("role") == split.VALIDATION))
            entity_cal = cal.filter(F.col("model") == one_model)
            entity_tgt = tgt.filter(F.col("model") == one_model)
            rated_cal, rated_tgt, _ = weights.density_ratios(entity_cal, entity_tgt)
            key = ["seed", "condition"]
            wc, wt = conformal.bounded_weights(rated_cal, rated_tgt, key, clip_min=clip_min, clip_max=clip_max)
            scores = cal.join(wc.select(*key, ENTITY, "weight"), [*key, ENTITY])
            targets = tgt.join(wt.select(*key, ENTITY, "weight"), [*key, ENTITY])
            found = conformal.weighted_quantiles(scores, targets, CELL, design.alphas, bounded=True, require_finite=design.policy == conformal.RAISE)
            found = found.withColumn("lower", F.col("pred") - F.col("quantile")).withColumn("upper", F.col("pred") + F.col("quantile"))
            diag = conformal.weight_diagnostics(wc, wt, key).withColumn("domain", F.lit(domain))
            intervals = found if intervals is None else intervals.unionByName(found)
            diagnostics = diag if diagnostics is None else diagnostics.unionByName(diag)
    return intervals, diagnostics


def adaptive_conformal(predictions: DataFrame, design: Design, *, source: Column | None = None, order: str = ENTITY) -> DataFrame:
    """Prequential adaptive trace per (cell, domain) in increasing entity order."""
    calibration = predictions.filter(F.col("role") == split.CALIBRATION)
    if source is not None:
        calibration = calibration.filter(source)
    targets = predictions.filter(F.col("role") == split.VALIDATION)
    stream = [*CELL, *(["domain"] if "domain" in predictions.columns else [])]
    return adaptive.adaptive_trace(targets, calibration, CELL, stream, design.alphas, order=order)


def varying(rows: DataFrame, sensors: Sequence[str]) -> list[str]:
    kept = {r.sensor for r in kept_sensors(sensor_variances(rows, sensors)).filter("keep").collect()}
    return [s for s in sensors if s in kept]


def featured_panel(
    panel: DataFrame, sensors: Sequence[str], *, train_entities: DataFrame | None = None, carry: Sequence[str] = (), name: str = "features"
) -> tuple[DataFrame, list[str]]:
    """Choose varying sensors on training rows and compute all features once, written."""
    fit_rows = panel.join(train_entities, ENTITY, "left_semi") if train_entities is not None else panel
    kept = varying(fit_rows, sensors)
    out = temporal_features(panel, kept, carry=carry, with_next=True)
    return stored(out, name), feature_names(kept)


def quantile_band_conformal(
    features: DataFrame, names: Sequence[str], design: Design, *, trees: int = 10, depth: int = 5, name: str = "bands"
) -> tuple[DataFrame, DataFrame]:
    """Conformalised quantile bands: leaf quantiles at alpha / 2 and 1 - alpha / 2."""
    ends = prepare_endpoints(features, design, name=name)
    train = training_rows(features.drop("next_cycle"), ends.roles, entity_lives(features), grid_table(features, design))
    probabilities = [p for a in design.alphas for p in (a / 2.0, 1.0 - a / 2.0)]
    rows = None
    for seed in design.seeds:
        for condition in [c[0] for c in design.conditions]:
            here = (F.col("seed") == seed) & (F.col("condition") == condition)
            fit_on = stored(train.filter(here).select(*names, "rul_capped"), f"{name}-training")
            fitted = models.fit_leaf_quantiles(fit_on, names, probabilities, trees=trees, depth=depth, seed=int(seed))
            mine = ends.rows.filter(here)
            keys = ["seed", "condition", "role", ENTITY, "rul_raw", "rul_capped", "cap"]
            part = fitted.predict(mine.select(*keys, *names), keys)
            bands = F.array(
                *[
                    F.struct(
                        F.lit(float(a)).alias("alpha"),
                        F.col("quantiles")[2 * i].alias("band_lower"),
                        F.col("quantiles")[2 * i + 1].alias("band_upper"),
                    )
                    for i, a in enumerate(design.alphas)
                ]
            )
            part = part.select(*keys, F.explode(bands).alias("_b")).select(*keys, "_b.*")
            rows = part if rows is None else rows.unionByName(part)
    rows = stored(rows.withColumn("model", F.lit("leaf_quantiles")), f"{name}-rows")
    scored = conformal.band_scores(rows.filter(F.col("role") == split.CALIBRATION))
    cell = [*CELL, "alpha"]
    quantiles = conformal.calibrate_bands(scored, cell, policy=design.policy)
    validation = rows.filter(F.col("role") == split.VALIDATION).withColumn("y_true", F.col("rul_capped").cast("double"))
    return quantiles, conformal.band_intervals(validation, quantiles, cell)


def regime_models(
    features: DataFrame, names: Sequence[str], design: Design, *, boosting: dict | None = None, name: str = "regimes"
) -> tuple[DataFrame, dict[int, RegimeScaler]]:
    """Point models on regime-scaled features; scaler and models see training entities only. Scalers are applied as read back."""
    ends = prepare_endpoints(features, design, name=name)
    train = training_rows(features.drop("next_cycle"), ends.roles, entity_lives(features), grid_table(features, design))
    out, scalers = None, {}
    for seed in design.seeds:
        fit_on = stored(train.filter(F.col("seed") == seed).select(*names, "rul_capped"), f"{name}-training")
        path = scratch_path(features.sparkSession, f"{name}-scaler")
        RegimeScaling(featureCols=list(names), seed=int(seed)).fit(fit_on).write().save(path)
        scalers[seed] = RegimeScalingModel.load(path).scaler
        scaled = scalers[seed].transform(fit_on, keep=["rul_capped"])
        fitted = models.fit_point_models(stored(scaled.drop("regime"), f"{name}-scaled"), names, boosting=boosting)
        rows = ends.rows.filter(F.col("seed") == seed)
        keys = ["seed", "condition", "cap", "role", ENTITY, "rul_raw", "rul_capped"]
        ready = scalers[seed].assign(rows.select(*keys, *names))
        ready = scale_by_regime(ready, scalers[seed].statistics, names)
        part = models.predict_long(fitted, ready, keys)
        out = part if out is None else out.unionByName(part)
    scored = score_endpoints(out, cap=RUL_CAP)
    return (
        scored.withColumn("y_true_raw", F.col("rul_raw").cast("double")).withColumn("y_true", F.col("rul_capped").cast("double")),
        scalers,
    )


def audit_grid(predictions: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared cells against the reservoirs: the calibration rows of each key."""
    store = predictions.filter(F.col("role") == split.CALIBRATION)
    sizes = store.groupBy(*keys).agg(F.count(F.lit(1)).alias("reservoir_size"))
    return stored(reservoir.cell_grid(cells, sizes), "audit-grid")


def audit_outcomes(
    predictions: DataFrame, grid: DataFrame, keys: Sequence[str], *, scale: float = RUL_CAP, slices: int | None = None
) -> DataFrame:
    """Every possible quantile with its probability and its outcome on the validation rows."""
    store = predictions.filter(F.col("role") == split.CALIBRATION)
    evaluation = predictions.filter(F.col("role") == split.VALIDATION)
    distribution = stored(reservoir.quantile_distribution(store, grid, keys, slices=slices), "audit-distribution")
    return stored(
        reservoir.quantile_outcomes(distribution, evaluation, keys, scale=scale, slices=slices), "audit-outcomes"
    )


def reservoir_audit(
    predictions: DataFrame, cells: DataFrame, keys: Sequence[str], *, scale: float = RUL_CAP, slices: int | None = None
) -> dict[str, DataFrame]:
    """All tables of the exact audit: the calibration rows are the reservoir, validation evaluates."""
    grid = audit_grid(predictions, cells, keys)
    outcomes = audit_outcomes(predictions, grid, keys, scale=scale, slices=slices)
    return {
        "cells": grid,
        "outcomes": outcomes,
        "beta_binomial": reservoir.beta_binomial(grid, keys),
        "beta": reservoir.beta_reference(grid, keys),
        "discrepancies": reservoir.discrepancies(outcomes, grid, keys),
    }
