"""Window features, quality gates, scans and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcal.functions.expressions import is_finite
from panelcal.operators import quality, split
from panelcal.operators.features import WINDOWS, feature_names, kept_sensors, sensor_variances, temporal_features
from panelcal.operators.labels import add_labels
from panelcal.operators.ranks import distributed_rank, grouped_position
from panelcal.plans import sql
from panelcal.plans.panels import EVENT_SENSORS, EVENT_SETTINGS, LINE_SENSORS, table
from panelcal.plans.queries import base
from panelcal.plans.registry import r, register, rounded
from panelcal.schema import CYCLE, ENTITY
from panelcal.session import configure, scratch_path, stored
from panelcal.sources import integrity, runs, text

# --- windows


def _feature_sql(panel: str, cte: str, sensors: tuple[str, ...], extra: str = "") -> str:
    windows = ", ".join(
        f"w{w} AS (PARTITION BY entity_id ORDER BY cycle ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in WINDOWS
    )
    columns = []
    for s in sensors:
        columns.append(f"{sql.r(f'coalesce({s} - lag({s}) OVER w0, 0)')} AS {s}_delta_1")
        for w in WINDOWS:
            columns.append(f"{sql.r(f'avg({s}) OVER w{w}')} AS {s}_rolling_mean_{w}")
            columns.append(f"{sql.r(f'stddev_pop({s}) OVER w{w}', 5)} AS {s}_rolling_std_{w}")
            slope = f"regr_slope({s}, p) OVER w{w}"
            columns.append(f"{sql.r(f'CASE WHEN p = 0 THEN 0 ELSE {slope} END', 5)} AS {s}_rolling_slope_{w}")
    return sql.query(
        [cte, f"pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY cycle) - 1 AS DOUBLE) AS p FROM {panel})"],
        f"""SELECT {extra}entity_id, cycle, op_setting_1, op_setting_2, op_setting_3, {', '.join(sensors)}, {', '.join(columns)},
        CAST(cycle AS DOUBLE) AS cycle_index FROM pos
        WINDOW w0 AS (PARTITION BY entity_id ORDER BY cycle), {windows}""",
    )


def _comparable(df, sensors):
    out = []
    for c in df.columns:
        if "_rolling_std_" in c or "_rolling_slope_" in c:
            out.append(r(c, 5))
        elif "_rolling_" in c or "_delta_" in c:
            out.append(r(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@register("event_window_features", _feature_sql("ev", sql.EVENTS, EVENT_SENSORS))
def event_window_features(spark, sf_dir):
    panel = base.events(spark, sf_dir)
    return _comparable(temporal_features(panel, EVENT_SENSORS, settings=EVENT_SETTINGS), EVENT_SENSORS)


@register("line_window_features", _feature_sql("li", sql.LINES, ("sensor_1", "sensor_3"), "domain, "))
def line_window_features(spark, sf_dir):
    """The same pass with long entities cut into chunks of 128 cycles."""
    panel = stored(base.lines(spark, sf_dir), "lines")
    out = temporal_features(panel, ("sensor_1", "sensor_3"), carry=("domain",), chunk_cycles=128)
    return _comparable(out.select("domain", *[c for c in out.columns if c != "domain"]), LINE_SENSORS)


@register(
    "varying_sensors",
    sql.query(
        [sql.EVENTS, sql.roles("ev", base.SEEDS)],
        " UNION ALL ".join(
            f"""SELECT seed, '{s}' AS sensor, {sql.r(f'var_pop({s})', 5)} AS variance, min({s}) AS low, max({s}) AS high,
            var_pop({s}) > 0 AND min({s}) <> max({s}) AS keep
            FROM ev JOIN roles USING (entity_id) WHERE role = 'base_train' GROUP BY seed"""
            for s in EVENT_SENSORS
        ),
    ),
)
def varying_sensors(spark, sf_dir):
    panel = base.events(spark, sf_dir)
    roles = split.assign_roles(panel, base.SEEDS).filter(F.col("role") == split.TRAIN)
    rows = panel.join(roles, ENTITY)
    table_ = kept_sensors(sensor_variances(rows, EVENT_SENSORS, ["seed"]))
    return table_.select("seed", "sensor", r("variance", 5), "low", "high", "keep")


@register(
    "row_positions",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events",
)
def row_positions(spark, sf_dir):
    rows = table(configure(spark), sf_dir, "events").select("event_id", "user_id", "ts")
    ranked = grouped_position(rows, ["user_id"], ["ts", "event_id"], F.to_date("ts"))
    return ranked.select("event_id", "user_id", (F.col("position") - 1).alias("position"))


@register(
    "distributed_rank",
    """SELECT l_extendedprice AS price, count(*) AS ties, min(rk) AS first_rank, max(rk) AS last_rank FROM (
       SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS rk FROM lineitem) GROUP BY 1""",
)
def distributed_rank_query(spark, sf_dir):
    rows = table(configure(spark), sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    ranked = distributed_rank(rows, [], "price", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return ranked.groupBy("price").agg(
        F.count(F.lit(1)).alias("ties"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank")
    )


@register(
    "sensor_series_slice",
    sql.query(
        [sql.LINES],
        """SELECT domain, entity_id, cycle, sensor, value FROM (
           SELECT domain, entity_id, cycle, sensor_1, sensor_3 FROM li
           WHERE entity_id = (SELECT min(l.entity_id) FROM li l WHERE l.domain = li.domain))
           UNPIVOT (value FOR sensor IN (sensor_1, sensor_3))""",
    ),
)
def sensor_series_slice(spark, sf_dir):
    """First entity of every domain, chosen sensors, as a long series."""
    panel = base.lines(spark, sf_dir)
    first = panel.groupBy("domain").agg(F.min(ENTITY).alias(ENTITY))
    rows = panel.join(first, ["domain", ENTITY], "left_semi").select("domain", ENTITY, CYCLE, "sensor_1", "sensor_3")
    return rows.unpivot(["domain", ENTITY, CYCLE], ["sensor_1", "sensor_3"], "sensor", "value")


# --- quality gates

_GATES = sql.query(
    [sql.EVENTS],
    """SELECT 'entity_id positive integer' AS rule, count(*) FILTER (NOT entity_id > 0) AS n_bad FROM ev
    UNION ALL SELECT 'cycle positive integer', count(*) FILTER (NOT cycle > 0) FROM ev
    UNION ALL SELECT 'op_setting_1 finite', count(*) FILTER (op_setting_1 IS NULL OR NOT isfinite(op_setting_1)) FROM ev
    UNION ALL SELECT 'sensor_1 finite', count(*) FILTER (sensor_1 IS NULL OR NOT isfinite(sensor_1)) FROM ev
    UNION ALL SELECT 'sensor_2 finite', count(*) FILTER (sensor_2 IS NULL OR NOT isfinite(sensor_2)) FROM ev
    UNION ALL SELECT 'unique (entity_id, cycle)', count(*) FROM (SELECT 1 FROM ev GROUP BY entity_id, cycle HAVING count(*) > 1)""",
)


@register("panel_gates", _GATES)
def panel_gates(spark, sf_dir):
    return quality.check_panel(base.events(spark, sf_dir), ["op_setting_1", "sensor_1", "sensor_2"])


@register(
    "table_gates",
    """SELECT 'price finite' AS rule, count(*) FILTER (l_extendedprice IS NULL OR NOT isfinite(l_extendedprice)) AS n_bad FROM lineitem
    UNION ALL SELECT 'quantity above 45', count(*) FILTER (l_quantity > 45) FROM lineitem
    UNION ALL SELECT 'unique (l_orderkey, l_linenumber)', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'line has an order', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'orders and lines match', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
      + (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))""",
)
def table_gates(spark, sf_dir):
    """Rules that real tables break: repeated keys, out-of-range rows, keys on one side only."""
    lines = table(configure(spark), sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = quality.check(lines, {"price finite": ~is_finite("l_extendedprice"), "quantity above 45": F.col("l_quantity") > 45})
    return (
        rows.unionByName(quality.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]))
        .unionByName(quality.unknown_keys(lines, orders, ["l_orderkey"], "line has an order"))
        .unionByName(quality.unmatched(lines, orders, ["l_orderkey"], "orders and lines match"))
    )


@register(
    "file_order_gate",
    """WITH o AS (SELECT l_suppkey + 1 AS entity_id, year(l_shipdate) * 12 + month(l_shipdate) AS c,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
           l_discount, l_tax, l_returnflag, l_linestatus) AS pos FROM lineitem),
       f AS (SELECT entity_id, c, lag(c) OVER (PARTITION BY entity_id ORDER BY pos) AS prev FROM o)
       SELECT entity_id, count(*) FILTER (prev >= c) AS n_bad FROM f GROUP BY 1""",
)
def file_order_gate(spark, sf_dir):
    """Ship months against the order of line keys; blocks are order-key ranges."""
    lines = table(configure(spark), sf_dir, "lineitem").withColumn("block", F.floor(F.col("l_orderkey") / 1000))
    order = [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ]
    placed = grouped_position(lines.withColumn("file", F.lit("lineitem")), ["file"], order, F.col("block"), out="ordinal")
    rows = placed.select(
        "file",
        F.floor((F.col("ordinal") - 1) / 5000).alias("block"),
        "ordinal",
        (F.col("l_suppkey") + 1).alias(ENTITY),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint").alias(CYCLE),
    )
    return quality.out_of_order(rows, "file", "block", "ordinal")


@register(
    "label_and_role_gates",
    sql.query(
        [sql.EVENTS, sql.roles("ev", base.SEEDS)],
        """SELECT 'label not negative' AS rule, count(*) FILTER (rul_raw < 0) AS n_bad FROM ev
        UNION ALL SELECT 'terminal label is zero', count(*) FILTER (rul_raw <> 0) FROM ev WHERE cycle = last_cycle
        UNION ALL SELECT 'roles disjoint', count(*) FROM (SELECT 1 FROM roles GROUP BY seed, entity_id HAVING count(*) > 1)
        UNION ALL SELECT 'roles cover entities', (SELECT count(*) FROM (SELECT DISTINCT entity_id FROM ev)) * 2 - (SELECT count(*) FROM roles)
        UNION ALL SELECT 'cut of a known entity', 0""",
    ),
)
def label_and_role_gates(spark, sf_dir):
    panel = stored(base.events(spark, sf_dir), "events")
    roles = stored(split.assign_roles(panel, base.SEEDS), "roles")
    return (
        quality.terminal_labels(add_labels(panel))
        .unionByName(quality.role_rules(roles, panel))
        .unionByName(quality.unknown_keys(roles, panel, [ENTITY], "cut of a known entity"))
    )


# --- scans and sinks

_LINE_SCHEMA = T.StructType(
    [T.StructField(ENTITY, T.LongType()), T.StructField(CYCLE, T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in (*EVENT_SETTINGS, *LINE_SENSORS)]
)


def _written_lines(spark, sf_dir) -> str:
    path = scratch_path(configure(spark), "trajectories")
    text.write_trajectories(base.lines(spark, sf_dir), path, [*EVENT_SETTINGS, *LINE_SENSORS], by=["domain"])
    return path


@register(
    "trajectory_text_scan",
    sql.query(
        [sql.LINES],
        "SELECT entity_id, cycle, op_setting_1, op_setting_2, op_setting_3, sensor_1, sensor_2, sensor_3, sensor_4 FROM li",
    ),
)
def trajectory_text_scan(spark, sf_dir):
    """Panel written as whitespace text and scanned back, bit for bit."""
    return text.scan_trajectories(spark, _written_lines(spark, sf_dir), _LINE_SCHEMA)


@register(
    "outcome_text_scan",
    sql.query(
        [sql.EVENTS],
        """SELECT entity_id, rul, alignment FROM (SELECT entity_id, last_cycle AS rul, 'matched' AS alignment FROM ev WHERE cycle = 1)""",
    ),
)
def outcome_text_scan(spark, sf_dir):
    """One outcome per line; the line number is the entity. Files hold 1,000 entities each."""
    panel = base.events(spark, sf_dir)
    path = scratch_path(spark, "outcomes")
    lives = panel.groupBy(ENTITY).agg(F.max(CYCLE).alias("rul"))
    group = F.floor((F.col(ENTITY) - 1) / 1000).alias("part")
    lines = lives.select(group, ENTITY, F.col("rul").cast("string").alias("value"))
    lines.repartition("part").sortWithinPartitions("part", ENTITY).select("part", "value").write.partitionBy("part").text(path)
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint")
    scanned = text.scan_outcomes(spark, path).select((F.col(ENTITY) + part * 1000).alias(ENTITY), "rul")
    return text.align_outcomes(panel, scanned)


@register(
    "panel_profile",
    sql.query(
        [sql.EVENTS],
        """SELECT count(*) AS rows, count(DISTINCT entity_id) AS entities, min(cycle) AS cycle_min, max(cycle) AS cycle_max,
        'sensor_3' AS constant_sensors, 0 AS missing_values FROM ev""",
    ),
)
def panel_profile(spark, sf_dir):
    return text.profile(base.events(spark, sf_dir), EVENT_SENSORS)


@register(
    "registry_integrity",
    sql.query(
        [sql.LINES],
        """SELECT domain, count(*) AS rows, count(DISTINCT entity_id) AS entities, CAST(0 AS BIGINT) AS files_with_errors,
        TRUE AS bytes_agree FROM li GROUP BY 1""",
    ),
)
def registry_integrity(spark, sf_dir):
    """Files of every domain against a stored registry of size, digest, rows and entities."""
    path = _written_lines(spark, sf_dir)
    parsed = text.scan_trajectories(spark, path, _LINE_SCHEMA, on_reject="keep")
    counts = stored(integrity.content_counts(parsed, depth=2), "counts")
    files = stored(integrity.file_inventory(spark, path, "part-*", depth=2), "inventory")
    register_path = scratch_path(spark, "registry")
    (
        files.join(counts, "filename")
        .select(
            "filename", F.lit("trajectory").alias("kind"), F.col("bytes").alias("expected_bytes"),
            F.col("rows").alias("expected_rows"), F.col("entities").alias("expected_entities"), "sha256",
        )
        .write.json(register_path)
    )
    checked = integrity.check_registry(integrity.read_registry(spark, register_path), files, counts)
    domain = F.regexp_extract("filename", "domain=([^/]+)/", 1).alias("domain")
    return (
        checked.groupBy(domain)
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("entities").alias("entities"),
            F.count_if(F.col("errors") != "").alias("files_with_errors"),
            (F.sum("bytes") > 0).alias("bytes_agree"),
        )
    )


@register("given_file_inventory")
def given_file_inventory(spark, sf_dir):
    """Path, bytes and SHA-256 of the given table files."""
    return integrity.file_inventory(configure(spark), sf_dir, "*.parquet").select("filename", "bytes", "sha256")


@register(
    "stored_predictions_scan",
    sql.query(
        base.event_ctes(sql.quantiles(base.ALPHAS), sql.INTERVALS),
        f"""SELECT seed, model, alpha, count(*) AS n, {sql.r('sum(y_true)')} AS truth, {sql.r('sum(pred)')} AS pred, {sql.r('sum(lower)')} AS lower,
        CAST(0 AS BIGINT) AS changed FROM intervals GROUP BY ALL""",
    ),
)
def stored_predictions_scan(spark, sf_dir):
    """Predictions stored as parquet and as CSV and read under the declared schema; both scans agree bit for bit."""
    from panelcal.plans.workloads import split_conformal

    _, intervals = split_conformal(base.event_predictions(spark, sf_dir), base.EVENTS_DESIGN)
    rows = intervals.select(F.lit("interval").alias("experiment"), F.lit("events").alias("target"), *_PREDICTION_COLUMNS)
    root = scratch_path(spark, "runs")
    runs.write_run({"predictions": rows}, root)
    parquet = runs.read_predictions(spark, f"{root}/predictions")
    runs.write_table(runs.in_schema_order(parquet), f"{root}/csv", partition_by=[], fmt="csv")
    csv = runs.read_predictions(spark, f"{root}/csv", fmt="csv")
    keys = ["seed", "model", "alpha", ENTITY]
    again = csv.select(*keys, F.struct("y_true", "pred", "lower", "upper").alias("again"))
    both = parquet.join(again, keys)
    same = F.struct("y_true", "pred", "lower", "upper") == F.col("again")
    return both.groupBy("seed", "model", "alpha").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.sum("y_true")).alias("truth"),
        rounded(F.sum("pred")).alias("pred"),
        rounded(F.sum("lower")).alias("lower"),
        F.count_if(~same).alias("changed"),
    )


_PREDICTION_COLUMNS = (
    "condition", "seed", "model", "alpha", ENTITY, "y_true_raw", "y_true", "pred_raw", "pred", "lower", "upper",
)


@register("split_manifest", sql.query([sql.EVENTS, sql.roles("ev", base.SEEDS)], "SELECT seed, entity_id, role FROM roles"))
def split_manifest(spark, sf_dir):
    path = scratch_path(configure(spark), "assignment")
    runs.write_assignment(split.assign_roles(base.events(spark, sf_dir), base.SEEDS), path)
    return spark.read.schema("entity_id bigint, role string, seed int").parquet(path)


@register("feature_contract")
def feature_contract(spark, sf_dir):
    """Fit, save, load and apply the feature estimator; sensors kept and rows produced."""
    from panelcal.operators.features import TemporalFeatures, TemporalFeaturesModel

    panel = base.events(spark, sf_dir)
    fitted = TemporalFeatures(sensorCols=list(EVENT_SENSORS)).fit(panel)
    path = scratch_path(spark, "feature-model")
    fitted.save(path)
    again = TemporalFeaturesModel.load(path)
    out = again.transform(panel)
    return out.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(feature_names(again.getOrDefault("keptSensors")))).alias("features"),
        F.lit("|".join(again.getOrDefault("keptSensors"))).alias("kept"),
    )
