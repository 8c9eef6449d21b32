"""Models, regimes and the composite workloads that fit them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcal.operators import metrics, models, regimes, split, weights
from panelcal.operators.features import feature_names, temporal_features
from panelcal.plans import sql
from panelcal.plans.panels import EVENT_SENSORS, LINE_SENSORS
from panelcal.plans.queries import base
from panelcal.plans.registry import r, register, rounded
from panelcal.plans.workloads import (
    CELL,
    Design,
    featured_panel,
    model_predictor,
    quantile_band_conformal,
    regime_models,
    scored_predictions,
    shift_matrix,
    split_conformal,
    varying,
    weighted_conformal,
)
from panelcal.schema import CYCLE, ENTITY
from panelcal.session import stored

_BOOST = {"iterations": 3, "depth": 3, "step": 0.3}
_DESIGN = Design(seeds=(13,), conditions=base.PRIMARY, alphas=base.ALPHAS, resamples=200, policy="infinite")

# --- exact models

_TRAINED = "tr AS (SELECT p.*, CAST(least(p.rul_raw, 125) AS DOUBLE) AS y FROM ev p JOIN roles r ON r.entity_id = p.entity_id AND r.seed = 13 AND r.role = 'base_train')"


def _train(spark, sf_dir):
    from panelcal.operators.labels import add_labels

    panel = base.events(spark, sf_dir)
    roles = split.assign_roles(panel, base.SEEDS[:1])
    return stored(split.with_role(add_labels(panel), roles, split.TRAIN), "train"), panel


@register(
    "mean_model",
    sql.query([sql.EVENTS, sql.roles("ev", base.SEEDS), _TRAINED], f"SELECT entity_id, cycle, {sql.r('(SELECT avg(y) FROM tr)')} AS pred_raw FROM ev"),
)
def mean_model(spark, sf_dir):
    train, panel = _train(spark, sf_dir)
    return models.fit_mean(train).predict(panel).select(ENTITY, CYCLE, r("pred_raw"))


@register(
    "ridge_one_feature",
    sql.query(
        [
            sql.EVENTS,
            sql.roles("ev", base.SEEDS),
            _TRAINED,
            """s AS (SELECT avg(cycle) AS mx, stddev_pop(cycle) AS sx, avg(y) AS my, count(*) AS n FROM tr),
            w AS (SELECT sum((cycle - mx) / sx * (y - my)) / (any_value(n) + 1) AS w FROM tr, s)""",
        ],
        f"SELECT entity_id, cycle, {sql.r('my + w * (cycle - mx) / sx')} AS pred_raw FROM ev, s, w",
    ),
)
def ridge_one_feature(spark, sf_dir):
    """Ridge with penalty 1 on one standardised feature has a closed form."""
    train, panel = _train(spark, sf_dir)
    model = models.fit_ridge(train, [CYCLE])
    return model.predict(panel).select(ENTITY, CYCLE, r("pred_raw"))


_CENTRES = ((6.0, 2.0, 1.0), (18.0, 4.0, 3.0), (12.0, 1.0, 2.0))


@register(
    "scale_by_given_regimes",
    sql.query(
        [
            sql.EVENTS,
            "dist AS (SELECT *, "
            + ", ".join(
                f"(op_setting_1 - {a}) * (op_setting_1 - {a}) + (op_setting_2 - {b}) * (op_setting_2 - {b}) + (op_setting_3 - {c}) * (op_setting_3 - {c}) AS d{i}"
                for i, (a, b, c) in enumerate(_CENTRES)
            )
            + " FROM ev)",
            "reg AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS regime FROM dist)",
            """st AS (SELECT regime, avg(sensor_1) AS m1, stddev_pop(sensor_1) AS s1, avg(sensor_2) AS m2, stddev_pop(sensor_2) AS s2, avg(sensor_3) AS m3
              FROM reg GROUP BY 1)""",
        ],
        f"""SELECT entity_id, cycle, regime, {sql.r('(sensor_1 - m1) / s1', 5)} AS sensor_1, {sql.r('(sensor_2 - m2) / s2', 5)} AS sensor_2,
        {sql.r('sensor_3 - m3')} AS sensor_3 FROM reg JOIN st USING (regime)""",
    ),
)
def scale_by_given_regimes(spark, sf_dir):
    """Nearest given centre, then per-regime standardisation; a constant feature is only centred."""
    panel = base.events(spark, sf_dir)
    labelled = regimes.assign_nearest(panel, _CENTRES, ["op_setting_1", "op_setting_2", "op_setting_3"])
    table = {}
    for row in regimes.regime_statistics(labelled, EVENT_SENSORS).collect():
        table.setdefault(int(row.regime), {})[row.feature] = (float(row["mean"]), float(row.sd))
    out = regimes.scale_by_regime(labelled, table, EVENT_SENSORS)
    return out.select(ENTITY, CYCLE, "regime", r("sensor_1", 5), r("sensor_2", 5), r("sensor_3"))


# --- fitted workloads (functionally defined; no SQL form)


@register("point_baselines")
def point_baselines(spark, sf_dir):
    """The three point models on window features; point metrics of the validation endpoints."""
    features, names = featured_panel(stored(base.events(spark, sf_dir), "events"), EVENT_SENSORS)
    predictions = scored_predictions(features, _DESIGN, model_predictor(names, boosting=_BOOST), name="baselines")
    rows = predictions.filter(F.col("role") == split.VALIDATION)
    found = metrics.point_metrics(metrics.point_variants(rows, CELL), [*CELL, "prediction_variant"])
    return found.select(*CELL, "prediction_variant", "n_endpoints", r("rmse", 4), r("mae", 4), r("signed_error", 4))


@register("model_split_conformal")
def model_split_conformal(spark, sf_dir):
    """Split-conformal intervals around mean and ridge on window features."""
    features, names = featured_panel(stored(base.events(spark, sf_dir), "events"), EVENT_SENSORS)
    predictions = scored_predictions(features, _DESIGN, model_predictor(names, only=("mean", "ridge")), name="models")
    _, intervals = split_conformal(predictions, _DESIGN)
    found = metrics.interval_metrics(intervals, CELL, scale=125)
    return found.select(*CELL, "alpha", "n_endpoints", r("coverage"), r("mean_width", 4))


@register("leaf_quantile_bands")
def leaf_quantile_bands(spark, sf_dir):
    """Quantile-forest bands, conformalised."""
    features, names = featured_panel(stored(base.events(spark, sf_dir), "events"), EVENT_SENSORS)
    _, intervals = quantile_band_conformal(features, names, _DESIGN, trees=5, depth=4)
    found = metrics.interval_metrics(stored(intervals, "bands"), CELL, scale=125)
    return found.select(*CELL, "alpha", "n_endpoints", r("coverage"), r("mean_width", 4))


@register("regime_search")
def regime_search(spark, sf_dir):
    """Silhouette per number of regimes and the chosen one."""
    panel = stored(base.events(spark, sf_dir), "events")
    fitted = regimes.fit_regime_scaler(panel, ["op_setting_1", "op_setting_2", "op_setting_3", "sensor_1", "sensor_2"])
    rows = [(int(k), float(v), k == fitted.n_regimes) for k, v in sorted(fitted.silhouettes.items())]
    out = spark.createDataFrame(rows, "k int, silhouette double, chosen boolean")
    return out.select("k", rounded("silhouette", 4).alias("silhouette"), "chosen")


@register("regime_scaled_models")
def regime_scaled_models(spark, sf_dir):
    features, names = featured_panel(stored(base.events(spark, sf_dir), "events"), EVENT_SENSORS[:1])
    predictions, _ = regime_models(features, names, _DESIGN, boosting=_BOOST)
    rows = predictions.filter(F.col("role") == split.VALIDATION)
    found = metrics.point_metrics(rows, CELL)
    return found.select(*CELL, "n_endpoints", r("rmse", 4), r("mae", 4))


@register("density_ratio_weights")
def density_ratio_weights(spark, sf_dir):
    """Logistic density ratio between one region's line settings and another's."""
    panel = stored(base.lines(spark, sf_dir), "lines")
    source, target = panel.filter(base.is_source()), panel.filter(F.col("domain") == "ASIA")
    rated_source, rated_target, fit = weights.density_ratios(source, target)
    both = rated_source.select("domain", "ratio").unionByName(rated_target.select("domain", "ratio"))
    return both.groupBy("domain").agg(
        F.count(F.lit(1)).alias("rows"),
        rounded(F.avg("ratio"), 4).alias("mean_ratio"),
        F.lit(fit["source_count"]).alias("source_count"),
        F.lit(fit["target_count"]).alias("target_count"),
    )


@register("weighted_conformal_shift")
def weighted_conformal_shift(spark, sf_dir):
    """Density-ratio weighted intervals for two target regions from one source region."""
    design = Design(seeds=(13,), conditions=base.PRIMARY, alphas=(0.4,), policy="infinite", domains=("ASIA", "AMERICA"))
    predictions = base.line_predictions(spark, sf_dir, design, train_filter=base.is_source())
    intervals, _ = weighted_conformal(predictions, design, base.is_source())
    found = metrics.interval_metrics(stored(intervals, "weighted"), ["domain", *CELL], scale=125)
    return found.select("domain", *CELL, "alpha", "n_endpoints", r("coverage"))


@register("model_shift_matrix")
def model_shift_matrix(spark, sf_dir):
    """Ridge on line features, fitted on one region and applied to all."""
    panel = stored(base.lines(spark, sf_dir), "lines")
    kept = varying(panel, LINE_SENSORS[:1])
    design = Design(seeds=(13,), conditions=base.PRIMARY, alphas=(0.4,), policy="infinite", domains=base.DOMAINS)

    def derive(rows):
        return stored(temporal_features(rows, kept, carry=("domain",), with_next=True), "features")

    predictor = model_predictor(feature_names(kept), only=("mean", "ridge"))
    intervals = shift_matrix(panel, design, predictor, base.is_source(), derive=derive)
    found = metrics.interval_metrics(intervals, ["domain", *CELL], scale=125)
    return found.select("domain", *CELL, "alpha", "n_endpoints", r("coverage"), r("mean_width", 3))


