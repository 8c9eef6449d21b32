"""Bands, weighted and adaptive calibration, domain shift, sensitivity and as-of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcal.functions.expressions import density_odds
from panelcal.operators import conformal, metrics, split
from panelcal.operators.models import leaf_table
from panelcal.operators.ranks import count_and_sum_up_to, first_at_or_above, order_statistics, running_totals
from panelcal.plans import sql
from panelcal.plans.panels import table
from panelcal.plans.queries import base
from panelcal.plans.registry import r, register, rounded
from panelcal.plans.workloads import (
    CELL,
    adaptive_conformal,
    entity_lives,
    grid_table,
    prepare_endpoints,
    shift_matrix,
    split_conformal,
    training_rows,
    progress_predictor,
)
from panelcal.schema import CYCLE, ENTITY
from panelcal.session import configure, stored

# --- bands

_BAND_ALPHA = 0.25
_BANDS = f"""
leaf AS (SELECT seed, condition, bucket, quantile_cont(y, {_BAND_ALPHA / 2}) AS lo, quantile_cont(y, {1 - _BAND_ALPHA / 2}) AS hi
  FROM trained GROUP BY ALL),
everywhere AS (SELECT seed, condition, quantile_cont(y, {_BAND_ALPHA / 2}) AS lo, quantile_cont(y, {1 - _BAND_ALPHA / 2}) AS hi
  FROM trained GROUP BY ALL),
banded AS (SELECT e.seed, e.condition, e.role, e.entity_id, CAST(e.rul_capped AS DOUBLE) AS y_true, coalesce(l.lo, a.lo) AS lo, coalesce(l.hi, a.hi) AS hi,
    greatest(coalesce(l.lo, a.lo) - e.rul_capped, e.rul_capped - coalesce(l.hi, a.hi), 0) AS score
  FROM ends e JOIN everywhere a ON a.seed = e.seed AND a.condition = e.condition LEFT JOIN leaf l ON l.seed = e.seed AND l.condition = e.condition AND l.bucket = CAST(floor(e.cycle / 10) AS BIGINT)),
bcal AS (SELECT *, row_number() OVER (PARTITION BY seed, condition ORDER BY score) AS rk, count(*) OVER (PARTITION BY seed, condition) AS n
  FROM banded WHERE role = 'calibration'),
bq AS (SELECT seed, condition, score AS quantile, n FROM bcal WHERE rk = CAST(ceil((n + 1) * (1 - {_BAND_ALPHA})) AS BIGINT))
"""


@register(
    "quantile_band_intervals",
    sql.query(
        base.event_ctes(_BANDS),
        f"""SELECT b.seed, b.condition, b.entity_id, b.y_true, {sql.r('lo')} AS band_lower, {sql.r('hi')} AS band_upper, {sql.r('quantile')} AS quantile,
        {sql.r('lo - quantile')} AS lower, {sql.r('hi + quantile')} AS upper
        FROM banded b JOIN bq USING (seed, condition) WHERE b.role = 'validation'""",
    ),
)
def quantile_band_intervals(spark, sf_dir):
    """Label quantiles per progress bucket as bands, widened by their conformity quantile."""
    panel = stored(base.with_next(stored(base.events(spark, sf_dir), "events")), "events-next")
    design = base.EVENTS_DESIGN
    ends = prepare_endpoints(panel, design)
    grid = grid_table(panel, design)
    bucket = F.floor(F.col(CYCLE) / 10).cast("bigint")
    train = training_rows(panel.drop("next_cycle"), ends.roles, entity_lives(panel), grid)
    # One leaf per seed, condition and bucket; an endpoint in a bucket without training rows gets the band of all of them.
    labelled = train.select(F.struct("seed", "condition").alias("tree"), F.explode(F.array(bucket, F.lit(-1).cast("bigint"))).alias("leaf"), F.col("rul_capped").cast("double").alias("label"))
    leaves = leaf_table(labelled, (_BAND_ALPHA / 2, 1 - _BAND_ALPHA / 2)).select("tree.seed", "tree.condition", F.col("leaf").alias("bucket"), "quantiles")
    everywhere = leaves.filter("bucket = -1").select("seed", "condition", F.col("quantiles").alias("all_quantiles"))
    rows = (
        ends.rows.withColumn("bucket", bucket)
        .join(everywhere, ["seed", "condition"])
        .join(leaves, ["seed", "condition", "bucket"], "left")
        .withColumn("quantiles", F.coalesce("quantiles", "all_quantiles"))
        .withColumn("band_lower", F.col("quantiles")[0])
        .withColumn("band_upper", F.col("quantiles")[1])
        .withColumn("alpha", F.lit(_BAND_ALPHA))
        .withColumn("y_true", F.col("rul_capped").cast("double"))
    )
    rows = stored(
        rows.select("seed", "condition", "alpha", "role", ENTITY, "y_true", "rul_capped", "band_lower", "band_upper"), "bands"
    )
    scores = conformal.band_scores(rows.filter(F.col("role") == split.CALIBRATION))
    keys = ["seed", "condition", "alpha"]
    quantiles = conformal.calibrate_bands(scores, keys)
    out = conformal.band_intervals(rows.filter(F.col("role") == split.VALIDATION), quantiles, keys)
    return out.select(
        "seed", "condition", ENTITY, "y_true", r("band_lower"), r("band_upper"), r("quantile"), r("lower"), r("upper")
    )


# --- weights

_RATIO = "sqrt(op_setting_1 / 7 + cycle / 90)"
_WEIGHTS = f"""
rated AS (SELECT *, CAST({_RATIO} AS DOUBLE) AS ratio FROM pred),
wcal AS (SELECT *, greatest(0.1, least(ratio, 10.0)) AS clipped FROM rated WHERE role = 'calibration'),
scales AS (SELECT seed, condition, model, avg(clipped) AS scale FROM wcal GROUP BY ALL),
calw AS (SELECT c.*, clipped / scale AS weight FROM wcal c JOIN scales USING (seed, condition, model)),
tgtw AS (SELECT t.*, greatest(0.1, least(ratio / scale, 10.0)) AS weight FROM rated t JOIN scales USING (seed, condition, model)
  WHERE role = 'validation'),
steps AS (SELECT seed, condition, model, score, sum(w) OVER (PARTITION BY seed, condition, model ORDER BY score) AS cw
  FROM (SELECT seed, condition, model, score, sum(weight) AS w FROM calw GROUP BY ALL)),
sums AS (SELECT seed, condition, model, sum(weight) AS total FROM calw GROUP BY ALL),
walpha AS (SELECT alpha FROM (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.25 AS DOUBLE))) t(alpha)),
asked_w AS (SELECT t.seed, t.condition, t.model, t.entity_id, t.pred, t.weight, alpha, (1 - alpha) * (total + t.weight) AS threshold
  FROM tgtw t JOIN sums USING (seed, condition, model) CROSS JOIN walpha)
"""
_WEIGHTED = f"""SELECT a.seed, a.condition, a.model, a.alpha, a.entity_id, {sql.r('any_value(a.weight)')} AS weight,
  {sql.r("coalesce(min(s.score), CAST('infinity' AS DOUBLE))")} AS quantile
  FROM asked_w a LEFT JOIN steps s ON s.seed = a.seed AND s.condition = a.condition AND s.model = a.model AND s.cw >= a.threshold
  GROUP BY a.seed, a.condition, a.model, a.alpha, a.entity_id"""


def _weighted_sides(spark, sf_dir):
    ratio = F.sqrt(F.col("op_setting_1") / 7 + F.col(CYCLE) / 90).alias("ratio")
    rows = base.event_predictions(spark, sf_dir).select("*", ratio)
    return conformal.bounded_weights(
        rows.filter(F.col("role") == split.CALIBRATION), rows.filter(F.col("role") == split.VALIDATION), CELL, clip_min=0.1, clip_max=10.0
    )


def _weighted(spark, sf_dir, bounded):
    scores, targets = _weighted_sides(spark, sf_dir)
    found = conformal.weighted_quantiles(
        scores, targets.drop("score"), CELL, base.ALPHAS, bounded=bounded, require_finite=False
    )
    return found.select(*CELL, "alpha", ENTITY, r("weight"), r("quantile"))


@register("weighted_quantiles_bounded", sql.query(base.event_ctes(_WEIGHTS), _WEIGHTED))
def weighted_quantiles_bounded(spark, sf_dir):
    return _weighted(spark, sf_dir, True)


@register("weighted_quantiles_asof", sql.query(base.event_ctes(_WEIGHTS), _WEIGHTED))
def weighted_quantiles_asof(spark, sf_dir):
    return _weighted(spark, sf_dir, False)


@register(
    "weight_diagnostics",
    sql.query(
        base.event_ctes(_WEIGHTS),
        f"""SELECT c.seed, c.condition, c.model, {sql.r('c.s')} AS calibration_weight_sum, {sql.r('c.ess')} AS calibration_effective_sample_size,
        {sql.r('t.lo')} AS target_weight_min, {sql.r('t.hi')} AS target_weight_max, {sql.r('t.m')} AS target_weight_mean
        FROM (SELECT seed, condition, model, sum(weight) AS s, sum(weight) * sum(weight) / sum(weight * weight) AS ess FROM calw GROUP BY ALL) c
        JOIN (SELECT seed, condition, model, min(weight) AS lo, max(weight) AS hi, avg(weight) AS m FROM tgtw GROUP BY ALL) t
        USING (seed, condition, model)""",
    ),
)
def weight_diagnostics(spark, sf_dir):
    found = conformal.weight_diagnostics(*_weighted_sides(spark, sf_dir), CELL)
    return found.select(*CELL, *[r(c) for c in found.columns if c not in CELL])


@register(
    "cumulative_weights",
    sql.query(base.event_ctes(_WEIGHTS), f"SELECT seed, condition, model, {sql.r('score')} AS score, {sql.r('cw')} AS cum_weight FROM steps"),
)
def cumulative_weights(spark, sf_dir):
    scores, _ = _weighted_sides(spark, sf_dir)
    return conformal.cumulative_weights(scores, CELL).select(*CELL, r("score"), r("cum_weight"))


@register(
    "density_odds",
    sql.query(
        [sql.LINES],
        f"""SELECT domain, t, count(*) AS n, {sql.r('avg(greatest(1e-8, least(p, 1 - 1e-8)) / greatest(1e-8, least(1 - p, 1)) * 3)', 5)} AS odds
        FROM (SELECT domain, CASE WHEN domain = 'EUROPE' THEN 0 ELSE 1 END AS t, CAST(sensor_3 * 10 AS DOUBLE) AS p FROM li) GROUP BY ALL""",
    ),
)
def density_odds_query(spark, sf_dir):
    """Source and target rows under a class label, and the odds of a given probability."""
    panel = base.lines(spark, sf_dir).select("domain", (F.col("sensor_3") * 10).alias("p"))
    source = panel.filter(base.is_source()).withColumn("t", F.lit(0))
    union = source.unionByName(panel.filter(~base.is_source()).withColumn("t", F.lit(1)))
    odds = density_odds("p", F.lit(3), F.lit(1))
    return union.groupBy("domain", "t").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(odds), 5).alias("odds"))


# --- adaptive

_ADAPTIVE = """
aalpha AS (SELECT alpha FROM (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.25 AS DOUBLE))) t(alpha)),
acal AS (SELECT seed, condition, model, score, row_number() OVER (PARTITION BY seed, condition, model ORDER BY score) AS rk,
    count(*) OVER (PARTITION BY seed, condition, model) AS n FROM pred WHERE role = 'calibration'),
asize AS (SELECT DISTINCT seed, condition, model, n FROM acal),
aseq AS (SELECT seed, condition, model, alpha, entity_id, pred, y_true, n,
    row_number() OVER (PARTITION BY seed, condition, model, alpha ORDER BY entity_id) AS s
  FROM pred JOIN asize USING (seed, condition, model) CROSS JOIN aalpha WHERE role = 'validation'),
walk AS (
  SELECT q.seed, q.condition, q.model, q.alpha, q.s, q.entity_id, q.alpha AS alpha_used, q.n, c.score AS quantile,
    CAST(ceil((q.n + CAST(1 AS DOUBLE)) * (1 - q.alpha)) AS BIGINT) AS requested_rank,
    (q.y_true < q.pred - c.score OR q.y_true > q.pred + c.score) AS miss
  FROM aseq q JOIN acal c ON c.seed = q.seed AND c.condition = q.condition AND c.model = q.model
    AND c.rk = least(q.n, CAST(ceil((q.n + CAST(1 AS DOUBLE)) * (1 - q.alpha)) AS BIGINT)) WHERE q.s = 1
  UNION ALL
  SELECT q.seed, q.condition, q.model, q.alpha, q.s, q.entity_id, w.a, q.n, c.score,
    CAST(ceil((q.n + CAST(1 AS DOUBLE)) * (1 - w.a)) AS BIGINT),
    (q.y_true < q.pred - c.score OR q.y_true > q.pred + c.score)
  FROM (SELECT seed, condition, model, alpha, s,
      greatest(least(alpha_used + CAST(0.01 AS DOUBLE) * (alpha - CASE WHEN miss THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END),
        CAST(0.999 AS DOUBLE)), CAST(0.001 AS DOUBLE)) AS a FROM walk) w
  JOIN aseq q ON q.seed = w.seed AND q.condition = w.condition AND q.model = w.model AND q.alpha = w.alpha AND q.s = w.s + 1
  JOIN acal c ON c.seed = q.seed AND c.condition = q.condition AND c.model = q.model
    AND c.rk = least(q.n, CAST(ceil((q.n + CAST(1 AS DOUBLE)) * (1 - w.a)) AS BIGINT)))
"""
ADAPTIVE_SQL = sql.query(
    base.event_ctes(_ADAPTIVE),
    f"""SELECT seed, condition, model, alpha, entity_id, {sql.r('alpha_used', 9)} AS alpha_used, {sql.r('quantile')} AS quantile,
    requested_rank, least(requested_rank, n) AS effective_rank, requested_rank <= n AS finite_rank_attainable,
    CASE WHEN requested_rank < n THEN 'interior' WHEN requested_rank = n THEN 'max_statistic' ELSE 'finite_quantile_unattainable' END AS quantile_regime,
    miss FROM walk""",
).replace("WITH ", "WITH RECURSIVE ", 1)
_TRACE_COLUMNS = ["requested_rank", "effective_rank", "finite_rank_attainable", "quantile_regime", "miss"]


@register("adaptive_trace", ADAPTIVE_SQL)
def adaptive_trace(spark, sf_dir):
    found = adaptive_conformal(base.event_predictions(spark, sf_dir), base.EVENTS_DESIGN)
    return found.select(*CELL, "alpha", ENTITY, r("alpha_used", 9), r("quantile"), *_TRACE_COLUMNS)


@register(
    "adaptive_diagnostics",
    sql.query(
        base.event_ctes(
            _ADAPTIVE,
            "final AS (SELECT *, max(s) OVER (PARTITION BY seed, condition, model, alpha) AS last FROM walk)",
        ),
        f"""SELECT seed, condition, model, alpha, {sql.r('min(quantile)')} AS quantile_min, {sql.r('max(quantile)')} AS quantile_max,
        count(DISTINCT quantile) AS distinct_quantiles, {sql.r('max(quantile) FILTER (s = 1)')} AS initial_quantile,
        {sql.r('max(quantile) FILTER (s = last)')} AS final_quantile,
        {sql.r('avg(CASE WHEN requested_rank > n THEN 1.0 ELSE 0.0 END)')} AS unattainable_rank_fraction FROM final GROUP BY seed, condition, model, alpha""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def adaptive_diagnostics(spark, sf_dir):
    found = adaptive_conformal(base.event_predictions(spark, sf_dir), base.EVENTS_DESIGN)
    keys = [*CELL, "alpha"]
    out = conformal.quantile_diagnostics(stored(found, "trace"), keys, order=ENTITY)
    names = ["quantile_min", "quantile_max", "initial_quantile", "final_quantile", "unattainable_rank_fraction"]
    return out.select(*keys, "distinct_quantiles", *[r(n) for n in names])


# --- domains and conditions


def _cell_metrics_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n_endpoints, {sql.r('avg(hit)')} AS coverage, {sql.r('avg(width)')} AS mean_width,
    {sql.r('avg(nis)')} AS normalized_interval_score FROM scored GROUP BY ALL"""


def _cell_metrics(intervals, cell):
    found = metrics.interval_metrics(intervals, cell, scale="cap")
    return found.select(*cell, "alpha", "n_endpoints", r("coverage"), r("mean_width"), r("normalized_interval_score"))


@register(
    "domain_shift_matrix",
    sql.query(
        base.line_ctes(
            sql.quantiles((0.25, 0.40), where="role = 'calibration' AND domain = 'EUROPE'", policy="infinite"),
            sql.INTERVALS,
            sql.SCORED,
            train_where="p.domain = 'EUROPE'",
            target_where="p.domain <> 'EUROPE'",
        ),
        _cell_metrics_sql("domain, seed, condition, model, alpha"),
    ),
)
def domain_shift_matrix(spark, sf_dir):
    """Fit and calibrated on one region; evaluated on its validation entities and on all of the other four."""
    panel = stored(base.with_next(stored(base.lines(spark, sf_dir), "lines"), ("domain",)), "lines-next")
    intervals = shift_matrix(panel, base.LINES_DESIGN, progress_predictor(), base.is_source())
    return _cell_metrics(intervals, ["domain", *CELL])


@register(
    "sensitivity_conditions",
    sql.query(
        base.line_ctes(sql.quantiles((0.25, 0.40)), sql.INTERVALS, sql.SCORED, conditions=split.CONDITIONS),
        _cell_metrics_sql("seed, condition, model, alpha"),
    ),
)
def sensitivity_conditions(spark, sf_dir):
    design = base.Design(seeds=base.SEEDS, conditions=split.CONDITIONS, alphas=(0.25, 0.40), domains=base.DOMAINS, policy="infinite")
    _, intervals = split_conformal(base.line_predictions(spark, sf_dir, design), design)
    return _cell_metrics(intervals, CELL)


@register(
    "adaptive_shift",
)
def adaptive_shift(spark, sf_dir):
    """Adaptive intervals per region from one source calibration: coverage per cell."""
    predictions = base.line_predictions(spark, sf_dir, train_filter=base.is_source())
    trace = adaptive_conformal(predictions, base.LINES_DESIGN, source=base.is_source())
    return _cell_metrics(stored(trace, "trace"), ["domain", *CELL])


# --- lookups on whole tables


@register(
    "cdf_at_points",
    """SELECT p.p_retailprice AS price, count(l.l_extendedprice) AS rows_upto, round(coalesce(sum(l.l_extendedprice), 0), 2) + 0 AS sum_upto
       FROM (SELECT DISTINCT p_retailprice FROM part) p LEFT JOIN lineitem l ON l.l_extendedprice <= p.p_retailprice GROUP BY 1""",
)
def cdf_at_points(spark, sf_dir):
    rows = table(configure(spark), sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price"))
    points = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("price"))
    return count_and_sum_up_to(points, rows, [], "price").select("price", "rows_upto", r("sum_upto", 2))


@register(
    "running_totals",
    """SELECT l_returnflag AS flag, l_extendedprice AS price, sum(q) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS upto
       FROM (SELECT l_returnflag, l_extendedprice, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)""",
)
def running_totals_query(spark, sf_dir):
    rows = table(configure(spark), sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("q")
    )
    return running_totals(rows, ["flag"], "price", {"q": "upto"}).select("flag", "price", "upto")


@register(
    "first_step_at_or_above",
    """WITH steps AS (SELECT l_extendedprice AS price, sum(q) OVER (ORDER BY l_extendedprice) AS cum
         FROM (SELECT l_extendedprice, sum(l_quantity) AS q FROM lineitem GROUP BY 1))
       SELECT o.o_orderkey, s.price FROM orders o ASOF LEFT JOIN steps s ON o.o_totalprice <= s.cum""",
)
def first_step_at_or_above(spark, sf_dir):
    """As-of join: the first price at which the running quantity reaches the order's total."""
    rows = table(configure(spark), sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("q"))
    steps = stored(running_totals(rows, [], "price", {"q": "cum"}), "steps")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("t"))
    return first_at_or_above(orders, steps, [], "t", "cum", "price").select("o_orderkey", "price")


@register(
    "order_statistics",
    """WITH s AS (SELECT l_returnflag AS flag, l_extendedprice AS price, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rk,
         count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
       a AS (SELECT share FROM (VALUES (CAST(0.001 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(1 AS DOUBLE))) t(share))
       SELECT flag, share, CAST(ceil(n * share) AS BIGINT) AS rank, price FROM s, a WHERE rk = CAST(ceil(n * share) AS BIGINT)""",
)
def order_statistics_query(spark, sf_dir):
    rows = table(configure(spark), sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    shares = F.array(*[F.lit(s) for s in (0.001, 0.5, 0.9, 1.0)])

    def wanted(sizes):
        return sizes.withColumn("share", F.explode(shares)).withColumn("rank", F.ceil(F.col("n") * F.col("share")))

    return order_statistics(rows, ["flag"], "price", wanted).select("flag", "share", "rank", "price")


