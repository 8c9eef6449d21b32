"""Cross-run report, provenance, completeness and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcal.operators import metrics, reporting, split
from panelcal.plans import sql
from panelcal.plans.queries import base
from panelcal.plans.registry import r, register, rounded
from panelcal.plans.workloads import CELL, adaptive_conformal, split_conformal

from panelcal.session import configure, scratch_path, stored
from panelcal.sources import integrity, runs

_CELLS = ["domain", "seed", "condition", "model"]
_FULL = base.line_ctes(
    sql.quantiles((0.25, 0.40), policy="infinite"),
    sql.INTERVALS,
    sql.SCORED,
    """pm AS (SELECT domain, seed, condition, model, variant, d FROM (
      SELECT domain, seed, condition, model, 'clipped' AS variant, pred - y_true AS d FROM pred WHERE role = 'validation'
      UNION ALL SELECT domain, seed, condition, model, 'raw', pred_raw - y_true_raw FROM pred WHERE role = 'validation')),
    pointw AS (SELECT domain, seed, condition, model, variant, sqrt(avg(d * d)) AS rmse, avg(abs(d)) AS mae, avg(d) AS signed_error,
      sum(CASE WHEN d < 0 THEN exp(-d / 13) - 1 ELSE exp(d / 10) - 1 END) AS nasa_score FROM pm GROUP BY ALL),
    pointl AS (UNPIVOT pointw ON rmse, mae, signed_error, nasa_score INTO NAME metric VALUE value)""",
)


def _rows(spark, sf_dir):
    predictions = base.line_predictions(spark, sf_dir)
    _, intervals = split_conformal(predictions, base.LINES_DESIGN)
    return predictions, stored(intervals, "intervals")


def _named(rows, result_type):
    return rows.select(
        F.lit(result_type).alias("result_type"),
        F.concat_ws("-", "domain", F.col("seed").cast("string")).alias("run_id"),
        *rows.columns,
    )


@register(
    "summary_over_seeds",
    sql.query(
        _FULL,
        f"""SELECT domain, condition, model, variant AS prediction_variant, metric, {sql.r('avg(value)', 3)} AS mean,
        {sql.r('stddev_samp(value)', 3)} AS sample_std, {sql.r('min(value)', 3)} AS minimum, {sql.r('max(value)', 3)} AS maximum,
        count(DISTINCT seed) AS n_seeds, count(value) AS n_numeric_values, string_agg(DISTINCT domain || '-' || seed, '|' ORDER BY domain || '-' || seed) AS run_ids
        FROM pointl GROUP BY domain, condition, model, variant, metric""",
    ),
)
def summary_over_seeds(spark, sf_dir):
    predictions, _ = _rows(spark, sf_dir)
    rows = reporting.point_rows(predictions.filter(F.col("role") == split.VALIDATION), _CELLS)
    named = _named(rows, "point")
    keys = ["domain", "condition", "model", "prediction_variant", "metric"]
    out = reporting.summarise(named, keys)
    return out.select(
        *keys, r("mean", 3), r("sample_std", 3), r("minimum", 3), r("maximum", 3), "n_seeds", "n_numeric_values", "run_ids"
    )


@register(
    "pending_summary",
    sql.query(
        _FULL,
        f"""SELECT model, metric, {sql.r('CASE WHEN count(v) = count(*) THEN avg(v) END', 3)} AS mean, count(DISTINCT seed) AS n_seeds,
        count(v) AS n_numeric_values, CASE WHEN count(v) = count(*) THEN 'numeric' ELSE 'pending' END AS metric_status
        FROM (SELECT *, CASE WHEN NOT (variant = 'raw' AND metric = 'mae' AND domain = 'ASIA') THEN value END AS v FROM pointl)
        GROUP BY model, metric""",
    ),
)
def pending_summary(spark, sf_dir):
    """One pending value makes its group's statistics pending."""
    predictions, _ = _rows(spark, sf_dir)
    rows = reporting.point_rows(predictions.filter(F.col("role") == split.VALIDATION), _CELLS)
    hidden = (F.col("prediction_variant") == "raw") & (F.col("metric") == "mae") & (F.col("domain") == "ASIA")
    rows = _named(rows, "point").withColumn("value", F.when(~hidden, F.col("value")))
    out = reporting.summarise(rows, ["model", "metric"])
    return out.select("model", "metric", r("mean", 3), "n_seeds", "n_numeric_values", "metric_status")


@register(
    "rank_diagnostics",
    sql.query(
        base.event_ctes(sql.quantiles((0.01, 0.1, 0.25), policy="legacy_max_clamp"), sql.INTERVALS),
        """SELECT q.seed, q.condition, q.model, q.alpha, n AS n_cal, requested_rank AS requested_rank_min, requested_rank AS requested_rank_max,
        effective_rank AS effective_rank_min, effective_rank AS effective_rank_max, CAST(attainable AS DOUBLE) AS finite_rank_attainable_fraction,
        regime AS quantile_regime, 1 AS n_distinct_quantiles FROM q""",
    ),
)
def rank_diagnostics(spark, sf_dir):
    from panelcal.operators import conformal

    predictions = base.event_predictions(spark, sf_dir)
    scores = predictions.filter(F.col("role") == split.CALIBRATION)
    quantiles = conformal.calibrate(scores, CELL, (0.01, 0.1, 0.25), policy=conformal.CLAMP)
    rows = predictions.filter(F.col("role") == split.VALIDATION).join(F.broadcast(quantiles), CELL)
    trace = rows.withColumn("alpha_used", F.col("alpha"))
    out = reporting.rank_diagnostics(trace, [*CELL, "alpha"], policy=conformal.CLAMP)
    return out.drop("unattainable_rank_fraction", "unattainable_rank_policy")


@register("adaptive_rank_diagnostics")
def adaptive_rank_diagnostics(spark, sf_dir):
    """Rank ranges along adaptive paths."""
    predictions = base.event_predictions(spark, sf_dir)
    trace = adaptive_conformal(predictions, base.EVENTS_DESIGN)
    sizes = reporting.calibration_sizes(predictions.filter(F.col("role") == split.CALIBRATION), CELL)
    rows = trace.join(F.broadcast(sizes), CELL)
    out = reporting.rank_diagnostics(rows, [*CELL, "alpha"], policy="legacy_max_clamp")
    return out.withColumns({c: rounded(c) for c in ("finite_rank_attainable_fraction", "unattainable_rank_fraction")})


@register(
    "run_provenance",
    sql.query(
        base.line_ctes(),
        """SELECT domain, seed, 'split_conformal' AS experiment, 'first-party' AS source, count(DISTINCT entity_id) FILTER (role = 'validation') AS endpoint_rows,
        count(DISTINCT entity_id) FILTER (role = 'calibration') AS n_cal FROM pred GROUP BY domain, seed""",
    ),
)
def run_provenance(spark, sf_dir):
    predictions = base.line_predictions(spark, sf_dir)
    keys = ["domain", "seed"]
    run_table = predictions.select(*keys).distinct().select(
        *keys, F.lit("split_conformal").alias("experiment"), F.lit("first-party").alias("source")
    )
    out = reporting.run_rows(run_table, predictions.filter(F.col("role") == split.VALIDATION), keys)
    sizes = reporting.calibration_sizes(predictions.filter(F.col("role") == split.CALIBRATION), keys)
    return out.join(sizes, keys, "left").withColumn("n_cal", F.coalesce("n_cal", F.lit(0)))


@register(
    "stored_metric_check",
    sql.query(
        _FULL,
        f"""SELECT domain, seed, model, variant AS prediction_variant, metric, {sql.r('value', 3)} AS value, domain <> 'AFRICA' OR metric <> 'mae' AS stored_metric_match
        FROM pointl""",
    ),
)
def stored_metric_check(spark, sf_dir):
    """Metrics stored as a table and recomputed from stored predictions; one stored metric is altered first."""
    predictions, _ = _rows(spark, sf_dir)
    rows = reporting.point_rows(predictions.filter(F.col("role") == split.VALIDATION), _CELLS)
    altered = (F.col("domain") == "AFRICA") & (F.col("metric") == "mae")
    path = scratch_path(spark, "metrics")
    runs.write_table(rows.withColumn("value", F.when(altered, F.col("value") + 1e-6).otherwise(F.col("value"))), path, partition_by=["seed"])
    keys = ["domain", "seed", "model", "prediction_variant", "metric"]
    out = reporting.verify_stored(spark.read.parquet(path), rows, keys)
    return out.select(*keys, r("value", 3), "stored_metric_match")


@register(
    "cross_run_report",
)
def cross_run_report(spark, sf_dir):
    """Whole report: point and interval rows per seed, then the summary over seeds."""
    predictions, intervals = _rows(spark, sf_dir)
    points = reporting.point_rows(predictions.filter(F.col("role") == split.VALIDATION), _CELLS).withColumn("alpha", F.lit(None).cast("double"))
    bands = reporting.interval_rows(intervals, _CELLS, scale=125, resamples=base.LINES_DESIGN.resamples).withColumn(
        "prediction_variant", F.lit(None).cast("string")
    )
    shared = ["result_type", "run_id", *_CELLS, "prediction_variant", "alpha", "metric", "value"]
    both = _named(points, "point").select(*shared).unionByName(_named(bands, "interval").select(*shared))
    keys = ["result_type", "domain", "condition", "model", "prediction_variant", "alpha", "metric"]
    out = reporting.summarise(both, keys)
    return out.select(*keys, r("mean"), r("sample_std"), r("minimum"), r("maximum"), "n_seeds", "n_numeric_values", "metric_status", "run_ids")


@register("report_tables")
def report_tables(spark, sf_dir):
    """Report tables written as CSV with their checksum table."""
    predictions, intervals = _rows(spark, sf_dir)
    tables = {
        "point_metrics_by_seed": reporting.point_rows(predictions.filter(F.col("role") == split.VALIDATION), _CELLS),
        "interval_metrics_by_seed": metrics.interval_metrics(intervals, _CELLS, scale=125),
    }
    sums = runs.write_report(tables, scratch_path(spark, "report"))
    return sums.select("filename", "bytes", "sha256")


# --- completeness and digests on run tables derived from the given tables

def _supplier_runs(spark, sf_dir):
    from panelcal.plans.panels import table

    return (
        table(configure(spark), sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("target"), F.col("s_nationkey").cast("bigint").alias("seed"), "s_suppkey")
    )


@register(
    "run_matrix_gaps",
    sql.query(
        [
            "members AS (SELECT r_name AS target, s_nationkey + CASE WHEN s_nationkey >= 20 THEN 25 ELSE 0 END AS seed, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)",
            "runs AS (SELECT target, seed FROM members)",
            "expected AS (SELECT t AS target, CAST(s AS BIGINT) AS seed FROM (SELECT unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST']) AS t) CROSS JOIN (SELECT unnest(range(25)) AS s))",
        ],
        """SELECT target, seed, 'missing' AS state FROM expected WHERE (target, seed) NOT IN (SELECT (target, seed) FROM runs)
        UNION ALL SELECT target, seed, 'unexpected' FROM runs WHERE (target, seed) NOT IN (SELECT (target, seed) FROM expected)
        UNION ALL SELECT target, seed, 'duplicate' FROM members WHERE n > 1""",
    ),
)
def run_matrix_gaps(spark, sf_dir):
    """Suppliers as runs of (region, nation) cells against a declared grid; the last nations' runs bear other seeds."""
    moved = F.when(F.col("seed") >= 20, F.col("seed") + 25).otherwise(F.col("seed"))
    actual = _supplier_runs(spark, sf_dir).withColumn("seed", moved)
    contract = integrity.expected_matrix(spark, "suppliers", base.DOMAINS, ["primary"], range(25))
    return integrity.matrix_gaps(actual, contract, ["target", "seed"])


@register(
    "tree_inventory_gaps",
    """WITH present AS (SELECT DISTINCT s_nationkey AS tree FROM supplier), indexed AS (SELECT DISTINCT c_nationkey + CASE WHEN c_nationkey >= 20 THEN 100 ELSE 0 END AS tree FROM customer)
       SELECT tree, 'missing' AS state FROM indexed WHERE tree NOT IN (SELECT tree FROM present)
       UNION ALL SELECT tree, 'unindexed' FROM present WHERE tree NOT IN (SELECT tree FROM indexed)""",
)
def tree_inventory_gaps(spark, sf_dir):
    from panelcal.plans.panels import table

    present = table(configure(spark), sf_dir, "supplier").select(F.col("s_nationkey").alias("tree"))
    # The index names the last nations' trees otherwise.
    indexed = table(spark, sf_dir, "customer").select(F.expr("c_nationkey + if(c_nationkey >= 20, 100, 0)").alias("tree"))
    return integrity.inventory_gaps(indexed, present)


@register(
    "index_contract",
    """WITH m AS (SELECT n_regionkey AS experiment, s_nationkey AS tree, count(*) AS manifests, max(s_suppkey % 2) <> min(s_suppkey % 2) AS mixed
         FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
       first_tree AS (SELECT experiment, min(tree) AS tree FROM m GROUP BY 1)
       SELECT experiment, FALSE AS official_tree_rule_broken, count(*) FILTER (mixed) AS trees_with_mixed_revisions,
       count(*) FILTER (manifests <> 4) AS trees_with_wrong_manifest_count FROM m GROUP BY 1""",
)
def index_contract(spark, sf_dir):
    """Nations as trees, regions as experiments; supplier parity plays the revision."""
    from pyspark.sql import Window

    from panelcal.plans.panels import table

    rows = table(configure(spark), sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    per = rows.groupBy(
        F.col("n_regionkey").alias("experiment"), F.col("s_nationkey").alias("tree"), (F.col("s_suppkey") % 2).cast("string").alias("revision")
    ).agg(F.count(F.lit(1)).alias("manifests"))
    first = F.min("tree").over(Window.partitionBy("experiment"))  # at most 25 nations
    index = per.withColumn("status", F.when(F.col("tree") == first, "OFFICIAL").otherwise("SUPERSEDED")).withColumns(
        {"targets": F.lit(2), "conditions": F.lit(1), "seeds": F.lit(2)}
    )
    return integrity.index_contract(index)


@register(
    "artifact_comparison",
    """WITH d AS (SELECT s_nationkey AS run_id, s_suppkey AS artifact, sha256(s_name) AS h FROM supplier),
       o AS (SELECT s_nationkey AS run_id, CASE WHEN s_suppkey % 11 = 4 THEN -s_suppkey ELSE s_suppkey END AS artifact,
               sha256(CASE WHEN s_suppkey % 5 = 2 THEN s_name || '!' ELSE s_name END) AS h FROM supplier)
       SELECT CAST(coalesce(d.run_id, o.run_id) AS VARCHAR) AS run_id, CAST(coalesce(d.artifact, o.artifact) AS VARCHAR) AS artifact,
       CASE WHEN o.h IS NULL THEN 'missing' WHEN d.h IS NULL THEN 'undeclared' WHEN d.h <> o.h THEN 'hash_mismatch' ELSE 'ok' END AS state
       FROM d FULL JOIN o ON d.run_id = o.run_id AND d.artifact = o.artifact""",
)
def artifact_comparison(spark, sf_dir):
    """Manifests written as JSON, scanned, exploded and compared with observed digests."""
    from panelcal.plans.panels import table

    suppliers = table(configure(spark), sf_dir, "supplier")
    declared = suppliers.select(
        F.col("s_nationkey").cast("string").alias("run_id"),
        F.map_from_arrays(F.array(F.col("s_suppkey").cast("string")), F.array(F.sha2("s_name", 256))).alias("artifacts"),
    )
    path = scratch_path(spark, "manifests")
    declared.write.json(path)
    scanned = integrity.declared_artifacts(integrity.read_manifests(spark, path))
    name = F.when(F.col("s_suppkey") % 5 == 2, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name"))
    # Some artifacts lie under another name, so one is missing and one undeclared.
    observed = suppliers.select(
        F.col("s_nationkey").cast("string").alias("run_id"),
        F.expr("if(s_suppkey % 11 = 4, -s_suppkey, s_suppkey)").cast("string").alias("artifact"),
        F.sha2(name, 256).alias("observed"),
    )
    return integrity.compare_artifacts(scanned, observed)


@register(
    "manifest_set_digest",
    """SELECT s_nationkey AS tree, count(*) AS members,
       sha256(string_agg(s_name || chr(0) || sha256(s_name) || chr(10), '' ORDER BY s_name || chr(0) || sha256(s_name) || chr(10))) AS set_sha256
       FROM supplier GROUP BY 1""",
)
def manifest_set_digest(spark, sf_dir):
    from panelcal.plans.panels import table

    rows = table(configure(spark), sf_dir, "supplier").select(
        F.col("s_nationkey").alias("tree"), "s_name", F.sha2("s_name", 256).alias("h")
    )
    return integrity.set_digest(rows, ["tree"], "s_name", "h")


@register(
    "cell_contract",
    """WITH declared AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS s FROM customer),
       held AS (SELECT c_nationkey + CASE WHEN c_nationkey <= 2 THEN 100 ELSE 0 END AS k, c_mktsegment AS s,
           CASE WHEN count(*) > 10 THEN 'evaluated' ELSE 'excluded' END AS status FROM customer GROUP BY ALL)
       SELECT * FROM (SELECT 'missing' AS state, (SELECT count(*) FROM declared WHERE (k, s) NOT IN (SELECT (k, s) FROM held)) AS cells
       UNION ALL SELECT 'unexpected', (SELECT count(*) FROM held WHERE (k, s) NOT IN (SELECT (k, s) FROM declared))
       UNION ALL SELECT 'stored ' || status, count(*) FROM held GROUP BY status) WHERE cells > 0""",
)
def cell_contract(spark, sf_dir):
    from panelcal.plans.panels import table

    customers = table(configure(spark), sf_dir, "customer")
    declared = customers.select("c_nationkey", "c_mktsegment").distinct()
    # The first nations' cells are held under other keys.
    moved = customers.withColumn("c_nationkey", F.expr("c_nationkey + if(c_nationkey <= 2, 100, 0)"))
    held = moved.groupBy("c_nationkey", "c_mktsegment").agg(
        F.when(F.count(F.lit(1)) > 10, "evaluated").otherwise("excluded").alias("status")
    )
    return integrity.cell_contract(declared, held, ["c_nationkey", "c_mktsegment"])


