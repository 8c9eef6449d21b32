"""Streaming queries; their oracles are those of the batch results they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcal.operators import labels, models, split
from panelcal.operators.features import temporal_features
from panelcal.plans import sql
from panelcal.plans.frozen import FrozenConformal, freeze
from panelcal.plans.panels import EVENT_SENSORS, EVENT_SETTINGS
from panelcal.plans.queries import base
from panelcal.plans.queries.calibration import ADAPTIVE_SQL
from panelcal.plans.queries.panel import _comparable, _feature_sql
from panelcal.plans.registry import r, register
from panelcal.plans.workloads import CELL, progress_means
from panelcal.schema import CYCLE, ENTITY
from panelcal.session import scratch_path, stored
from panelcal.streaming import adaptive as streaming
from panelcal.streaming.features import feature_stream, scored_stream
from panelcal.streaming.lookup import index_scores
from panelcal.streaming.ordered import finish, with_flush

_KEYS = [*CELL, "alpha"]


def _replayed(spark, rows, files: int = 4):
    """Rows written in a scattered order over several files, as a file stream."""
    path = scratch_path(spark, "stream-in")
    rows.repartition(files, F.xxhash64("seq", "ts")).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _endpoint_stream(spark, sf_dir):
    predictions = base.event_predictions(spark, sf_dir)
    scores = index_scores(predictions.filter(F.col("role") == split.CALIBRATION), CELL)
    grid = F.array(*[F.lit(a) for a in base.ALPHAS])
    rows = predictions.filter(F.col("role") == split.VALIDATION).select(
        "seed",
        "condition",
        "model",
        F.explode(grid).alias("alpha"),
        F.timestamp_seconds(F.col(ENTITY)).alias("ts"),
        F.col(ENTITY).alias("seq"),
        F.col("pred").alias("center"),
        F.col("y_true").alias("truth"),
    )
    return rows, scores


@register("adaptive_stream", ADAPTIVE_SQL)
def adaptive_stream(spark, sf_dir):
    rows, scores = _endpoint_stream(spark, sf_dir)
    marker = {"seed": -1, "condition": "flush", "model": "flush", "alpha": 0.5, "seq": 0}
    stream = _replayed(spark, with_flush(rows, marker, 3600))
    out = streaming.adaptive_stream(stream, scores, _KEYS)
    done = finish(out, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint"))
    return done.filter("seed >= 0").select(
        *_KEYS,
        F.col("seq").alias(ENTITY),
        r("alpha_used", 9),
        r("quantile"),
        "requested_rank",
        "effective_rank",
        "finite_rank_attainable",
        "quantile_regime",
        "miss",
    )


@register(
    "prequential_stream",
    ADAPTIVE_SQL[: ADAPTIVE_SQL.rindex("SELECT seed, condition")]
    + f"SELECT seed, condition, model, alpha, entity_id, {sql.r('alpha_used', 9)} AS alpha_used, miss, 'ok' AS status FROM walk",
)
def prequential_stream(spark, sf_dir):
    """Predictions and outcomes as separate events; the resolved rows equal the batch trace."""
    rows, scores = _endpoint_stream(spark, sf_dir)
    asks = rows.withColumn("kind", F.lit(streaming.PREDICT)).withColumn("truth", F.lit(None).cast("double"))
    answers = (
        rows.withColumn("kind", F.lit(streaming.OUTCOME))
        .withColumn("center", F.lit(None).cast("double"))
        .withColumn("ts", F.col("ts") + F.expr("interval 200 milliseconds"))
    )
    marker = {"seed": -1, "condition": "flush", "model": "flush", "alpha": 0.5, "seq": 0, "kind": streaming.OUTCOME}
    stream = _replayed(spark, with_flush(asks.unionByName(answers), marker, 3600))
    out = streaming.adaptive_stream(stream, scores, _KEYS, separate_outcomes=True)
    done = finish(out, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint"))
    resolved = done.filter("seed >= 0 AND miss IS NOT NULL")
    return resolved.select(*_KEYS, F.col("seq").alias(ENTITY), r("alpha_used", 9), "miss", "status")


def _panel_stream(spark, panel):
    """Every row of a panel, its cycle as seconds of event time, scattered over files."""
    rows = panel.select(ENTITY, F.timestamp_seconds(F.col(CYCLE)).alias("ts"), F.col(CYCLE).alias("seq"), *EVENT_SETTINGS, *EVENT_SENSORS)
    stream = _replayed(spark, with_flush(rows, {ENTITY: -1, "seq": 0}, 3600))
    return feature_stream(stream, EVENT_SENSORS, settings=EVENT_SETTINGS)


@register("feature_stream", _feature_sql("ev", sql.EVENTS, EVENT_SENSORS))
def stream_features(spark, sf_dir):
    out = _panel_stream(spark, stored(base.events(spark, sf_dir), "events"))
    done = finish(out, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint"))
    return _comparable(done.filter(f"{ENTITY} > 0").drop("status"), ())


_ON_TIME_SQL = ADAPTIVE_SQL.replace(
    "CROSS JOIN aalpha WHERE role = 'validation'),", "CROSS JOIN aalpha WHERE role = 'validation' AND entity_id % 7 <> 3),"
)


@register(
    "late_rows_stream",
    _ON_TIME_SQL[: _ON_TIME_SQL.rindex("SELECT seed, condition")]
    + f"""SELECT seed, condition, model, alpha, entity_id, {sql.r('alpha_used', 9)} AS alpha_used, {sql.r('quantile')} AS quantile, miss, 'ok' AS status FROM walk
UNION ALL
SELECT seed, condition, model, alpha, entity_id, NULL, NULL, NULL, 'late' FROM pred CROSS JOIN aalpha WHERE role = 'validation' AND entity_id % 7 = 3""",
)
def late_rows_stream(spark, sf_dir):
    """Every seventh entity's row comes after the watermark has passed all rows: it is reported, and the others' path is that without it."""
    rows, scores = _endpoint_stream(spark, sf_dir)
    rows = stored(rows, "late-rows")
    marker = {"seed": -1, "condition": "flush", "model": "flush", "alpha": 0.5, "seq": 0}
    flushed = with_flush(rows, marker, 3600)
    delayed = F.col("seq") % 7 == 3
    path = scratch_path(spark, "stream-in")
    # One file a batch, in the order they are written.
    for part in (rows.filter(~delayed), flushed.filter("seed < 0"), flushed.filter("seed < 0"), rows.filter(delayed)):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = streaming.adaptive_stream(stream, scores, _KEYS)
    done = finish(out, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint"))
    return done.filter("seed >= 0").select(*_KEYS, F.col("seq").alias(ENTITY), r("alpha_used", 9), r("quantile"), "miss", "status")


_SCORES = f"""SELECT e.entity_id, e.cycle, {sql.r('coalesce(b.m, o.m)')} AS pred_raw
  FROM ev e CROSS JOIN (SELECT m FROM overall WHERE seed = 13) o
  LEFT JOIN (SELECT bucket, m FROM bybucket WHERE seed = 13) b ON b.bucket = CAST(floor(e.cycle / 10) AS BIGINT)"""


@register("bucket_model_stream", sql.query(base.event_ctes(), _SCORES))
def bucket_model_stream(spark, sf_dir):
    """A frozen predictor applied to every arriving row by a stream-static join."""
    from panelcal.plans.workloads import entity_lives, grid_table, training_rows

    panel = base.events(spark, sf_dir)
    roles = split.assign_roles(panel, base.SEEDS[:1])
    train = training_rows(panel, roles, entity_lives(panel), grid_table(panel, base.EVENTS_DESIGN))
    bucket = F.floor(F.col(CYCLE) / 10).cast("bigint")
    by_bucket, overall = progress_means(train, bucket)
    path = scratch_path(spark, "frozen")
    by_bucket.write.parquet(f"{path}/bucket")
    overall.write.parquet(f"{path}/overall")
    table_ = spark.read.parquet(f"{path}/bucket").select("bucket", "bucket_mean")
    rows = panel.select(ENTITY, CYCLE)
    rows.write.parquet(f"{path}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/rows")
    # One row: the overall mean of the frozen fit.
    joined = stream.withColumn("bucket", bucket).join(table_, "bucket", "left").crossJoin(
        F.broadcast(spark.read.parquet(f"{path}/overall").select("overall"))
    )
    out = joined.select(ENTITY, CYCLE, F.coalesce("bucket_mean", "overall").alias("pred_raw"))
    done = finish(out, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint"))
    return done.select(ENTITY, CYCLE, r("pred_raw"))


_FROZEN = "sensor_1_rolling_mean_5"


@register(
    "frozen_model_stream",
    sql.query(
        [
            sql.EVENTS,
            sql.roles("ev", base.SEEDS),
            "fe AS (SELECT *, avg(sensor_1) OVER (PARTITION BY entity_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM ev)",
            "tr AS (SELECT x, CAST(least(rul_raw, 125) AS DOUBLE) AS y FROM fe JOIN roles USING (entity_id) WHERE seed = 13 AND role = 'base_train')",
            """s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM tr),
            w AS (SELECT sum((x - mx) / sx * (y - my)) / (any_value(n) + 1) AS w FROM tr, s),
            scored AS (SELECT entity_id, cycle, 'mean' AS model, my AS p FROM fe, s
              UNION ALL SELECT entity_id, cycle, 'ridge', my + w * (x - mx) / sx FROM fe, s, w)""",
        ],
        f"SELECT entity_id, cycle, model, {sql.r('p')} AS pred_raw, {sql.r('greatest(0.0, least(p, 125))')} AS pred FROM scored",
    ),
)
def frozen_model_stream(spark, sf_dir):
    """A saved and loaded fit scores the features that the same streaming query computes; every row of the panel is scored."""
    panel = stored(base.events(spark, sf_dir), "events")
    featured = temporal_features(labels.add_labels(panel), EVENT_SENSORS, settings=EVENT_SETTINGS, carry=("rul_capped",))
    # Computed once: the fit and each pass of the calibration read what they need of it.
    featured = stored(featured.select(ENTITY, CYCLE, _FROZEN, "rul_capped"), "featured")
    roles = stored(split.assign_roles(panel, base.SEEDS[:1]), "roles")
    train = stored(split.with_role(featured, roles, split.TRAIN), "train")
    last = labels.last_cycles(panel)
    calibration = split.with_role(featured, roles, split.CALIBRATION).join(last, ENTITY).where(F.col(CYCLE) == F.col("last_cycle"))
    fitted = [models.fit_mean(train), models.fit_ridge(train, [_FROZEN])]
    path = scratch_path(spark, "frozen-fit")
    freeze(fitted, calibration, [_FROZEN], cap=125.0, alphas=base.ALPHAS).save(spark, path)
    out = scored_stream(_panel_stream(spark, panel), FrozenConformal.load(spark, path))
    done = finish(out, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint"))
    return done.filter(f"{ENTITY} > 0").select(ENTITY, CYCLE, "model", r("pred_raw"), r("pred"))
