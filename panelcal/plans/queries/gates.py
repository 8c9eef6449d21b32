"""One query per gate, each over whole tables of which derived rows are damaged: how many rows or cells break a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcal.operators import gates, split
from panelcal.operators.labels import add_labels, last_cycles
from panelcal.operators.quality import interval_rules
from panelcal.plans import sql
from panelcal.plans.panels import table
from panelcal.plans.queries import base
from panelcal.plans.registry import register
from panelcal.schema import CYCLE, ENTITY
from panelcal.session import configure, stored
from panelcal.sources.runs import check_predictions


@register(
    "raw_column_gate",
    """SELECT 'panel columns present' AS rule, CAST(0 AS BIGINT) AS n_bad
       UNION ALL SELECT 'no columns outside the panel contract', count(DISTINCT r_name) - 4 FROM region""",
)
def raw_column_gate(spark, sf_dir):
    """The supplier panel names a domain beside keys, settings and sensors."""
    return gates.column_rules(base.lines(spark, sf_dir))


@register(
    "interval_gate",
    """SELECT 'bounds finite' AS rule, count(*) FILTER (l_discount = 0) AS n_bad FROM lineitem
       UNION ALL SELECT 'lower not above upper', count(*) FILTER (l_linenumber % 3 = 0 AND l_tax > 0 AND l_discount <> 0) FROM lineitem""",
)
def interval_gate(spark, sf_dir):
    """Bounds around every line's price; those without a discount have no upper one, every third line's are swapped."""
    lines = table(configure(spark), sf_dir, "lineitem")
    swapped = F.col("l_linenumber") % 3 == 0
    low, high = F.col("l_extendedprice") - F.col("l_tax"), F.col("l_extendedprice") + F.col("l_tax")
    upper = F.when(F.col("l_discount") == 0, float("inf")).when(swapped, low).otherwise(high)
    rows = lines.select("l_orderkey", F.when(swapped, high).otherwise(low).alias("lower"), upper.alias("upper"))
    return gates.checked(rows, interval_rules(), "intervals")[1]


@register(
    "prediction_gate",
    """SELECT 'pred_raw finite' AS rule, count(*) FILTER (l_tax = 0 OR l_linenumber = 2) AS n_bad FROM lineitem
       UNION ALL SELECT 'pred finite', count(*) FILTER (l_linenumber = 2) FROM lineitem""",
)
def prediction_gate(spark, sf_dir):
    """Predictions of every line, missing for second lines and infinite without a tax; the clipped ones are finite again."""
    lines = table(configure(spark), sf_dir, "lineitem")
    raw = F.when(F.col("l_linenumber") == 2, None).when(F.col("l_tax") == 0, float("inf")).otherwise(F.col("l_quantity").cast("double"))
    rows = lines.select(raw.alias("pred_raw")).withColumn("pred", F.when(F.col("pred_raw").isNotNull(), F.least("pred_raw", F.lit(125.0))))
    return gates.checked(rows, gates.prediction_rules(["pred_raw", "pred"]), "predictions")[1]


@register(
    "cut_gate",
    sql.query(
        [sql.EVENTS, "lives AS (SELECT entity_id, max(cycle) AS n FROM ev GROUP BY 1)", "cut AS (SELECT c_custkey AS entity_id, 1 + c_custkey % 12 AS c FROM customer)"],
        """SELECT 'cut of a known entity' AS rule, count(*) FILTER (n IS NULL) AS n_bad FROM cut LEFT JOIN lives USING (entity_id)
        UNION ALL SELECT 'cut within the life', count(*) FILTER (n IS NOT NULL AND c > n) FROM cut LEFT JOIN lives USING (entity_id)""",
    ),
)
def cut_gate(spark, sf_dir):
    """A cut for every customer against the users that have events."""
    panel = base.events(spark, sf_dir)
    cuts = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias(ENTITY), (1 + F.col("c_custkey") % 12).cast("bigint").alias("cut"))
    return gates.checked(*gates.cut_rules(cuts, last_cycles(panel)), "cuts")[1]


@register(
    "distribution_gate",
    """WITH m AS (SELECT l_suppkey AS k, l_quantity / 50 AS x, count(*) AS c FROM lineitem GROUP BY ALL),
       p AS (SELECT k, CASE WHEN k % 4 = 1 THEN x + 1 ELSE x END AS x,
               c / sum(c) OVER (PARTITION BY k) * CASE WHEN k % 5 = 2 THEN 1.5 ELSE 1 END AS p FROM m),
       s AS (SELECT k, sum(p) AS mass, max(x) AS hi FROM p GROUP BY 1)
       SELECT 'masses finite' AS rule, CAST(0 AS BIGINT) AS n_bad UNION ALL SELECT 'no negative mass', 0
       UNION ALL SELECT 'mass sums to one', count(*) FILTER (abs(mass - 1) > 1e-12) FROM s
       UNION ALL SELECT 'values within the support', count(*) FILTER (hi > 1) FROM s""",
)
def distribution_gate(spark, sf_dir):
    """Quantities of each supplier's lines as a distribution on the unit interval; some cells weigh too much, some leave the interval."""
    lines = table(configure(spark), sf_dir, "lineitem")
    counts = lines.groupBy(F.col("l_suppkey").alias("k"), (F.col("l_quantity").cast("double") / 50).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("k").agg(F.sum("c").alias("n"))
    weight = F.when(F.col("k") % 5 == 2, 1.5).otherwise(1.0)
    value = F.when(F.col("k") % 4 == 1, F.col("x") + 1).otherwise(F.col("x"))
    rows = counts.join(sizes, "k").select("k", value.alias("value"), (F.col("c") / F.col("n") * weight).alias("probability"))
    return gates.checked(*gates.distribution_cells(rows, ["k"], support=(0.0, 1.0)), "distribution-cells")[1]


@register(
    "subset_mass_gate",
    """WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
       c AS (SELECT k, n, n - CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS held FROM s)
       SELECT 'multiplicities sum to the subset count' AS rule, count(*) FILTER (held <> n) AS n_bad FROM c""",
)
def subset_mass_gate(spark, sf_dir):
    """Subsets of one supplier of each nation, one position each; a third of the nations declare one subset too few."""
    suppliers = table(configure(spark), sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).cast("decimal(38,0)").alias("multiplicity"))
    sizes = suppliers.groupBy("k").agg((F.count(F.lit(1)) - F.when(F.col("k") % 3 == 0, 1).otherwise(0)).cast("decimal(38,0)").alias("combination_count"))
    return gates.checked(*gates.multiplicity_cells(suppliers.join(sizes, "k"), ["k"]), "subset-cells")[1]


@register(
    "truth_gate",
    sql.query(
        [sql.EVENTS, sql.roles("ev", base.SEEDS), sql.cuts("ev", base.PRIMARY)],
        """SELECT 'endpoint has a truth' AS rule, count(*) FILTER (seed = 13 AND entity_id % 6 = 1) AS n_bad FROM cuts
        UNION ALL SELECT 'one truth an endpoint', count(*) FILTER (entity_id % 6 <> 1 AND cut % 4 = 0) FROM cuts WHERE seed = 13""",
    ),
)
def truth_gate(spark, sf_dir):
    """Endpoints of every entity's cut against the labels, of which some entities' are gone and some cycles' are there twice."""
    panel = stored(base.with_next(stored(base.events(spark, sf_dir), "events")), "events-next")
    labelled = add_labels(panel)
    grid = split.seed_table(spark, base.SEEDS[:1]).crossJoin(split.condition_table(spark, base.PRIMARY))
    ends = split.cut_points(last_cycles(panel), grid).select(ENTITY, F.col("cut").alias(CYCLE))
    damaged = labelled.filter(F.col(ENTITY) % 6 != 1)
    twice = damaged.unionByName(damaged.filter(F.col(CYCLE) % 4 == 0))
    return gates.checked(*gates.with_truth(ends, twice, ["rul_raw", "rul_capped"]), "truths")[1]


@register(
    "stored_prediction_gate",
    sql.query(
        [sql.EVENTS],
        """SELECT 'predictions not empty' AS rule, CAST(0 AS BIGINT) AS n_bad
        UNION ALL SELECT 'one row per entity and cell', count(*) FROM (SELECT entity_id, CAST(op_setting_3 AS BIGINT) AS c FROM ev GROUP BY ALL HAVING count(*) > 1)""",
    ),
)
def stored_prediction_gate(spark, sf_dir):
    """Predictions of every event, stored under its type as the cell, where users repeat."""
    rows = base.events(spark, sf_dir).select(ENTITY, F.col("op_setting_3").cast("bigint").alias("cell"))
    return check_predictions(stored(rows, "stored-predictions"), ["cell"])
