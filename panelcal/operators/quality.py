"""Quality gates: every rule is a count of bad rows, and any count above zero fails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcal.functions.expressions import is_finite
from panelcal.schema import CYCLE, ENTITY, ContractError

RULE_SCHEMA = "rule string, n_bad bigint"


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All row rules in one aggregate. A rule is a predicate that is true for a bad row."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n_bad")) for n in rules])
    return counts.select(F.explode(pairs).alias("r")).select("r.rule", "r.n_bad")


def assert_clean(report: DataFrame) -> None:
    """Raise with every failing rule, not only the first."""
    bad = report.filter(F.col("n_bad") > 0).orderBy("rule").collect()
    if bad:
        raise ContractError("; ".join(f"{r.rule}: {r.n_bad}" for r in bad))


def positive_integer(name: str) -> Column:
    """Bad: an id or cycle that is missing, not finite, fractional or not positive."""
    c = F.col(name).cast("double")
    return ~(is_finite(c) & (c > 0) & (c == F.floor(c)))


def row_rules(keys: Sequence[str], values: Sequence[str]) -> dict[str, Column]:
    rules = {f"{k} positive integer": positive_integer(k) for k in keys}
    rules.update({f"{v} finite": ~is_finite(v) for v in values})
    return rules


def check_panel(panel: DataFrame, values: Sequence[str], *, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Row rules plus uniqueness of the panel key."""
    rows = check(panel, row_rules([ENTITY, CYCLE], values))
    return rows.unionByName(duplicate_keys(panel, [*by, CYCLE]))


def duplicate_keys(df: DataFrame, keys: Sequence[str], rule: str | None = None) -> DataFrame:
    name = rule or f"unique ({', '.join(keys)})"
    repeated = df.groupBy(*keys).count().filter(F.col("count") > 1)
    return repeated.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("rule"), "n_bad")


def out_of_order(
    rows: DataFrame, file: str, block: str, ordinal: str, *, entity: str = ENTITY, cycle: str = CYCLE
) -> DataFrame:
    """Rows whose cycle does not exceed the entity's previous cycle in file order.

    Inside a file block a lag sees the previous row; across blocks the last row of one block
    is compared with the first of the next. No window holds more than one block of an entity,
    or one row per block.
    """
    inner = Window.partitionBy(entity, file, block).orderBy(ordinal)
    within = rows.withColumn("_prev", F.lag(cycle).over(inner)).select(
        entity, F.when(F.col("_prev") >= F.col(cycle), 1).otherwise(0).alias("bad")
    )
    ends = rows.groupBy(entity, file, block).agg(
        F.min_by(cycle, ordinal).alias("_first"), F.max_by(cycle, ordinal).alias("_last")
    )
    outer = Window.partitionBy(entity, file).orderBy(block)
    across = ends.withColumn("_prev", F.lag("_last").over(outer)).select(
        entity, F.when(F.col("_prev") >= F.col("_first"), 1).otherwise(0).alias("bad")
    )
    return within.unionByName(across).groupBy(entity).agg(F.sum("bad").alias("n_bad"))


def terminal_labels(labelled: DataFrame, *, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Labels never negative, and zero on the last cycle of every entity."""
    ends = labelled.groupBy(*by).agg(
        F.max_by("rul_raw", CYCLE).alias("terminal"), F.count_if(F.col("rul_raw") < 0).alias("negative")
    )
    totals = ends.agg(
        F.count_if(F.col("terminal") != 0).alias("terminal"), F.coalesce(F.sum("negative"), F.lit(0)).alias("negative")
    )
    pairs = F.array(
        F.struct(F.lit("label not negative").alias("rule"), F.col("negative").alias("n_bad")),
        F.struct(F.lit("terminal label is zero").alias("rule"), F.col("terminal").alias("n_bad")),
    )
    return totals.select(F.explode(pairs).alias("r")).select("r.rule", "r.n_bad")


def one_row_per_entity(df: DataFrame, cell: Sequence[str], entity: Sequence[str] = (ENTITY,)) -> DataFrame:
    return duplicate_keys(df, [*cell, *entity], "one row per entity and cell")


def interval_rules(lower: str = "lower", upper: str = "upper") -> dict[str, Column]:
    return {
        "bounds finite": ~(is_finite(lower) & is_finite(upper)),
        "lower not above upper": F.col(lower) > F.col(upper),
    }


def role_rules(assignment: DataFrame, entities: DataFrame, keys: Sequence[str] = ("seed",)) -> DataFrame:
    """Roles are disjoint, and every entity has one under every seed."""
    disjoint = duplicate_keys(assignment, [*keys, ENTITY], "roles disjoint")
    wanted = entities.select(ENTITY).distinct().crossJoin(assignment.select(*keys).distinct())
    uncovered = wanted.join(assignment, [*keys, ENTITY], "left_anti")
    return disjoint.unionByName(
        uncovered.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit("roles cover entities").alias("rule"), "n_bad")
    )


def unknown_keys(rows: DataFrame, known: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys of ``rows`` that ``known`` does not hold."""
    missing = rows.select(*keys).distinct().join(known.select(*keys).distinct(), list(keys), "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(rule).alias("rule"), "n_bad")


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys present on one side only, such as features without a label."""
    both = unknown_keys(left, right, keys, rule).unionByName(unknown_keys(right, left, keys, rule))
    return both.groupBy("rule").agg(F.sum("n_bad").alias("n_bad"))


def differs(stored: Column, again: Column, *, tolerance: float = 1e-11) -> Column:
    """Bad: a stored metric that its recomputation does not reproduce."""
    gap = F.greatest(tolerance * F.greatest(F.abs(stored), F.abs(again)), F.lit(tolerance))
    return F.abs(stored - again) > gap
