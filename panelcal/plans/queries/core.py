"""Labels, roles, cuts, endpoints, calibration, intervals and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcal.functions.expressions import asymmetric_penalty, interval_score
from panelcal.operators import conformal, metrics, split
from panelcal.operators.labels import add_labels, endpoints
from panelcal.plans import sql
from panelcal.plans.queries import base
from panelcal.plans.registry import r, register, rounded
from panelcal.plans.workloads import entity_lives, grid_table, interval_report, split_conformal
from panelcal.schema import ENTITY

CELL = ["seed", "condition", "model"]


@register(
    "remaining_life_labels",
    sql.query([sql.LINES], "SELECT domain, entity_id, cycle, rul_raw, least(rul_raw, 125) AS rul_capped FROM li"),
)
def remaining_life_labels(spark, sf_dir):
    return add_labels(base.lines(spark, sf_dir)).select("domain", ENTITY, "cycle", "rul_raw", "rul_capped")


@register("entity_roles", sql.query([sql.EVENTS, sql.roles("ev", base.SEEDS)], "SELECT seed, entity_id, role FROM roles"))
def entity_roles(spark, sf_dir):
    return split.assign_roles(base.events(spark, sf_dir), base.SEEDS)


@register(
    "fit_and_reservoir_roles",
    sql.query(
        [sql.LINES, sql.roles("li", base.SEEDS)],
        """SELECT seed, entity_id, CASE WHEN role = 'base_train' THEN 'fit' ELSE 'reservoir' END AS audit_role,
        CASE role WHEN 'calibration' THEN 'former_calibration' WHEN 'validation' THEN 'former_validation' END AS origin_role
        FROM roles""",
    ),
)
def fit_and_reservoir_roles(spark, sf_dir):
    roles = split.assign_roles(base.lines(spark, sf_dir), base.SEEDS)
    return split.fit_reservoir_roles(roles).select("seed", ENTITY, "audit_role", "origin_role")


@register(
    "role_rows",
    sql.query(
        [sql.EVENTS, sql.roles("ev", base.SEEDS)],
        "SELECT entity_id, cycle, sensor_1 FROM ev WHERE entity_id IN (SELECT entity_id FROM roles WHERE seed = 13 AND role = 'calibration')",
    ),
)
def role_rows(spark, sf_dir):
    panel = base.events(spark, sf_dir)
    roles = split.assign_roles(panel, base.SEEDS[:1])
    return split.with_role(panel, roles, split.CALIBRATION).select(ENTITY, "cycle", "sensor_1")


@register(
    "sensitivity_cut_points",
    sql.query(
        [sql.LINES, sql.roles("li", base.SEEDS), sql.cuts("li", split.CONDITIONS)],
        "SELECT seed, condition, cap, entity_id, cut FROM cuts",
    ),
)
def sensitivity_cut_points(spark, sf_dir):
    panel = base.lines(spark, sf_dir)
    design = base.Design(seeds=base.SEEDS, conditions=split.CONDITIONS)
    return split.cut_points(entity_lives(panel), grid_table(panel, design)).select("seed", "condition", "cap", ENTITY, "cut")


@register(
    "prefix_rows",
    sql.query(
        [sql.EVENTS, sql.roles("ev", base.SEEDS), sql.cuts("ev", base.PRIMARY)],
        "SELECT c.seed, e.entity_id, e.cycle, c.cut, e.sensor_1 FROM ev e JOIN cuts c ON c.entity_id = e.entity_id AND e.cycle <= c.cut",
    ),
)
def prefix_rows(spark, sf_dir):
    panel = base.events(spark, sf_dir)
    cuts = split.cut_points(entity_lives(panel), grid_table(panel, base.EVENTS_DESIGN))
    return split.restrict_to_cuts(panel, cuts).select("seed", ENTITY, "cycle", "cut", "sensor_1")


@register(
    "endpoint_rows",
    sql.query(
        [sql.LINES],
        "SELECT domain, entity_id, cycle, op_setting_1, sensor_1, sensor_2, sensor_3 FROM li WHERE cycle = last_cycle",
    ),
)
def endpoint_rows(spark, sf_dir):
    panel = base.lines(spark, sf_dir).select("domain", ENTITY, "cycle", "op_setting_1", "sensor_1", "sensor_2", "sensor_3")
    return endpoints(panel, ["domain", ENTITY])


@register(
    "endpoint_scores",
    sql.query(
        base.event_ctes(),
        f"""SELECT seed, condition, role, entity_id, cycle, model, rul_raw, rul_capped, {sql.r('pred_raw')} AS pred_raw,
        {sql.r('pred')} AS pred, {sql.r('score')} AS score, rul_raw > 30 AS saturated FROM pred""",
    ),
)
def endpoint_scores(spark, sf_dir):
    return base.event_predictions(spark, sf_dir).select(
        "seed", "condition", "role", ENTITY, "cycle", "model", "rul_raw", "rul_capped",
        r("pred_raw"), r("pred"), r("score"), (F.col("rul_raw") > 30).alias("saturated"),
    )


QUANTILE_SELECT = f"""SELECT seed, condition, model, alpha, {sql.r('quantile')} AS quantile, n AS n_cal, requested_rank,
  effective_rank, attainable AS finite_rank_attainable, regime FROM q"""


def _quantile_columns(q):
    return q.select(
        "seed", "condition", "model", "alpha", r("quantile"), "n_cal", "requested_rank", "effective_rank",
        "finite_rank_attainable", "regime",
    )


@register("conformal_quantiles_infinite", sql.query(base.event_ctes(sql.quantiles((0.01, 0.05, 0.1, 0.25))), QUANTILE_SELECT))
def conformal_quantiles_infinite(spark, sf_dir):
    scores = base.event_predictions(spark, sf_dir).filter(F.col("role") == split.CALIBRATION)
    return _quantile_columns(conformal.calibrate(scores, CELL, (0.01, 0.05, 0.1, 0.25), policy=conformal.INFINITE))


@register(
    "conformal_quantiles_clamped",
    sql.query(base.line_ctes(sql.quantiles((0.01, 0.1, 0.4), policy="legacy_max_clamp")), QUANTILE_SELECT),
)
def conformal_quantiles_clamped(spark, sf_dir):
    scores = base.line_predictions(spark, sf_dir).filter(F.col("role") == split.CALIBRATION)
    return _quantile_columns(conformal.calibrate(scores, CELL, (0.01, 0.1, 0.4), policy=conformal.CLAMP))


@register(
    "split_conformal_intervals",
    sql.query(
        base.event_ctes(sql.quantiles(base.ALPHAS), sql.INTERVALS),
        f"""SELECT seed, condition, model, alpha, entity_id, y_true, {sql.r('pred')} AS pred, {sql.r('lower')} AS lower,
        {sql.r('upper')} AS upper FROM intervals""",
    ),
)
def split_conformal_intervals(spark, sf_dir):
    _, intervals = split_conformal(base.event_predictions(spark, sf_dir), base.EVENTS_DESIGN)
    return intervals.select(*CELL, "alpha", ENTITY, "y_true", r("pred"), r("lower"), r("upper"))


@register(
    "interval_metrics",
    sql.query(
        base.event_ctes(sql.quantiles(base.ALPHAS), sql.INTERVALS, sql.SCORED),
        f"""SELECT seed, condition, model, alpha, count(*) AS n_endpoints, {sql.r('avg(hit)')} AS coverage,
        {sql.r('avg(width)')} AS mean_width, {sql.r('avg(nis)')} AS normalized_interval_score FROM scored GROUP BY ALL""",
    ),
)
def interval_metrics(spark, sf_dir):
    _, intervals = split_conformal(base.event_predictions(spark, sf_dir), base.EVENTS_DESIGN)
    found = metrics.interval_metrics(intervals, CELL, scale="cap")
    return found.select(*CELL, "alpha", "n_endpoints", r("coverage"), r("mean_width"), r("normalized_interval_score"))


@register(
    "interval_scores",
    sql.query(
        base.event_ctes(sql.quantiles(base.ALPHAS), sql.INTERVALS),
        f"""SELECT seed, model, alpha, entity_id, {sql.r('(upper - lower) + (2 / alpha) * (greatest(lower - y_true, 0) + greatest(y_true - upper, 0))')} AS score
        FROM intervals""",
    ),
)
def interval_scores(spark, sf_dir):
    _, intervals = split_conformal(base.event_predictions(spark, sf_dir), base.EVENTS_DESIGN)
    value = rounded(interval_score("y_true", "lower", "upper", "alpha")).alias("score")
    return intervals.select("seed", "model", "alpha", ENTITY, value)


POINT_SELECT = f"""SELECT seed, condition, model, prediction_variant, count(*) AS n_endpoints, {sql.r('sqrt(avg(d * d))')} AS rmse,
  {sql.r('avg(abs(d))')} AS mae, {sql.r('avg(d)')} AS signed_error,
  {sql.r('sum(CASE WHEN d < 0 THEN exp(-d / 13) - 1 ELSE exp(d / 10) - 1 END)', 4)} AS nasa_score FROM errors GROUP BY ALL"""
POINT_ERRORS = """errors AS (
  SELECT seed, condition, model, 'clipped' AS prediction_variant, pred - y_true AS d FROM pred WHERE role = 'validation'
  UNION ALL SELECT seed, condition, model, 'raw', pred_raw - y_true_raw FROM pred WHERE role = 'validation')"""


@register("point_metrics", sql.query(base.event_ctes(POINT_ERRORS), POINT_SELECT))
def point_metrics(spark, sf_dir):
    rows = base.event_predictions(spark, sf_dir).filter(F.col("role") == split.VALIDATION)
    keys = [*CELL, "prediction_variant"]
    found = metrics.point_metrics(metrics.point_variants(rows, CELL), keys)
    return found.select(*keys, "n_endpoints", r("rmse"), r("mae"), r("signed_error"), r("nasa_score", 4))


@register(
    "asymmetric_penalties",
    sql.query(
        base.event_ctes(),
        f"""SELECT seed, role, model, entity_id, {sql.r('CASE WHEN pred - y_true < 0 THEN exp(-(pred - y_true) / 13) - 1 ELSE exp((pred - y_true) / 10) - 1 END')} AS penalty
        FROM pred""",
    ),
)
def asymmetric_penalties(spark, sf_dir):
    rows = base.event_predictions(spark, sf_dir)
    value = rounded(asymmetric_penalty(F.col("pred") - F.col("y_true"))).alias("penalty")
    return rows.select("seed", "role", "model", ENTITY, value)


@register(
    "endpoint_evaluation",
    sql.query(
        base.event_ctes(),
        f"""SELECT seed, model, count(*) AS n_endpoints, {sql.r('sqrt(avg((pred - y_true) * (pred - y_true)))')} AS rmse,
        {sql.r('avg(abs(pred - y_true))')} AS mae FROM pred WHERE role = 'validation' GROUP BY ALL""",
    ),
)
def endpoint_evaluation(spark, sf_dir):
    rows = base.event_predictions(spark, sf_dir).filter(F.col("role") == split.VALIDATION)
    return metrics.evaluate_endpoints(rows, ["seed", "model"]).select("seed", "model", "n_endpoints", r("rmse"), r("mae"))


def _bootstrap_ctes(mode: str) -> list[str]:
    resamples = base.EVENTS_DESIGN.resamples
    draws = f"draws AS (SELECT CAST(range AS BIGINT) AS b FROM range({resamples}))"
    if mode == "multinomial":
        u = sql.HEX13.format(key="seed || ':' || b || ':' || j")
        samples = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY seed, condition, model, alpha ORDER BY entity_id) AS pos FROM bounded),
sizes AS (SELECT seed, condition, model, alpha, count(*) AS n FROM bounded GROUP BY ALL),
picks AS (SELECT seed, condition, model, alpha, b, CAST(floor({u} / CAST(4503599627370496 AS DOUBLE) * n) AS BIGINT) + 1 AS pos
  FROM (SELECT s.*, b, CAST(unnest(range(n)) AS BIGINT) AS j FROM sizes s CROSS JOIN draws)),
samples AS (SELECT seed, condition, model, alpha, b, avg(hit) AS coverage, avg(width) AS mean_width, avg(nis) AS normalized_interval_score
  FROM picks JOIN numbered USING (seed, condition, model, alpha, pos) GROUP BY ALL)"""
    else:
        u = sql.HEX13.format(key="seed || ':' || b || ':' || entity_id")
        bounds, total, mass = [], 0.0, 0.36787944117144233
        for k in range(1, 20):
            total += mass
            bounds.append(f"CASE WHEN u >= CAST({total!r} AS DOUBLE) THEN 1 ELSE 0 END")
            mass /= k
        samples = f"""weighted AS (SELECT *, {' + '.join(bounds)} AS w FROM (SELECT s.*, b, {u} / CAST(4503599627370496 AS DOUBLE) AS u FROM bounded s CROSS JOIN draws)),
samples AS (SELECT seed, condition, model, alpha, b, sum(hit * w) / sum(w) AS coverage, sum(width * w) / sum(w) AS mean_width,
  sum(nis * w) / sum(w) AS normalized_interval_score FROM weighted WHERE w > 0 GROUP BY ALL)"""
    long = " UNION ALL ".join(
        f"SELECT seed, condition, model, alpha, '{m}' AS metric, {m} AS v FROM samples" for m in metrics.INTERVAL_METRICS
    )
    bounded = "bounded AS (SELECT * FROM scored WHERE isfinite(width))"
    found = f"""found AS (SELECT seed, condition, model, alpha, metric, {sql.r('quantile_cont(v, 0.025)')} AS low,
        {sql.r('quantile_cont(v, 0.975)')} AS high FROM long GROUP BY ALL)"""
    cells = f"""cells AS (SELECT seed, condition, model, alpha, bool_and(isfinite(width)) AS bounded, metric FROM scored
        CROSS JOIN (SELECT unnest({list(metrics.INTERVAL_METRICS)}) AS metric) GROUP BY ALL)"""
    return base.event_ctes(sql.quantiles(base.ALPHAS), sql.INTERVALS, sql.SCORED, bounded, draws, samples, f"long AS ({long})", found, cells)


def _bootstrap_sql(mode: str) -> str:
    return sql.query(
        _bootstrap_ctes(mode),
        """SELECT seed, condition, model, alpha, metric, CASE WHEN bounded THEN low END AS bootstrap_ci_lower,
        CASE WHEN bounded THEN high END AS bootstrap_ci_upper, CASE WHEN bounded THEN 'numeric' ELSE 'pending' END AS bootstrap_status
        FROM cells LEFT JOIN found USING (seed, condition, model, alpha, metric)""",
    )


def _bootstrap(spark, sf_dir, mode):
    _, intervals = split_conformal(base.event_predictions(spark, sf_dir), base.EVENTS_DESIGN)
    found = metrics.bootstrap_intervals(intervals, CELL, scale="cap", resamples=base.EVENTS_DESIGN.resamples, mode=mode)
    return found.select(*CELL, "alpha", "metric", r("bootstrap_ci_lower"), r("bootstrap_ci_upper"), "bootstrap_status")


@register("bootstrap_multinomial", _bootstrap_sql("multinomial"))
def bootstrap_multinomial(spark, sf_dir):
    return _bootstrap(spark, sf_dir, "multinomial")


@register("bootstrap_poisson", _bootstrap_sql("poisson"))
def bootstrap_poisson(spark, sf_dir):
    return _bootstrap(spark, sf_dir, "poisson")


_VALUES = " UNION ALL ".join(
    f"SELECT seed, condition, model, alpha, '{m}' AS metric, count(*) AS n_endpoints, avg({c}) AS value FROM scored GROUP BY ALL"
    for m, c in zip(metrics.INTERVAL_METRICS, ("hit", "width", "nis"), strict=True)
)


@register(
    "split_conformal_report",
    sql.query(
        [*_bootstrap_ctes("poisson"), f"vals AS ({_VALUES})"],
        f"""SELECT seed, condition, model, alpha, metric, n_endpoints, CASE WHEN bounded THEN {sql.r('value')} END AS value,
        CASE WHEN bounded THEN 'numeric' ELSE 'pending' END AS metric_status, CASE WHEN bounded THEN low END AS bootstrap_ci_lower,
        CASE WHEN bounded THEN high END AS bootstrap_ci_upper, CASE WHEN bounded THEN 'numeric' ELSE 'pending' END AS bootstrap_status
        FROM cells JOIN vals USING (seed, condition, model, alpha, metric) LEFT JOIN found USING (seed, condition, model, alpha, metric)""",
    ),
)
def split_conformal_report(spark, sf_dir):
    """End to end: intervals, metrics and bootstrap bounds, long; unattainable cells stay as pending rows."""
    _, intervals = split_conformal(base.event_predictions(spark, sf_dir), base.EVENTS_DESIGN)
    found = interval_report(intervals, base.EVENTS_DESIGN, CELL)
    return found.select(
        *CELL, "alpha", "metric", "n_endpoints", r("value"), "metric_status", r("bootstrap_ci_lower"), r("bootstrap_ci_upper"), "bootstrap_status"
    )
