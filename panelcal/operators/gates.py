"""Gates that ride on the pass that makes a table: what they count costs no second scan.

The counts are observed metrics of the write. ``required`` hands the table on only if every count is zero, so a job
behind it never reads rows that break a rule.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelcal.functions.expressions import is_finite
from panelcal.operators.quality import RULE_SCHEMA, assert_clean
from panelcal.schema import CYCLE, ENTITY, SENSORS, SETTINGS
from panelcal.session import local_rows, stored


def checked(df: DataFrame, rules: dict[str, Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` as a stored table, and (rule, n_bad) of its rows, counted while it was written.

    A rule is a predicate that is true for a bad row; where it is null the row is bad too.
    """
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    counts = [F.count_if(F.coalesce(bad, F.lit(True))).alias(rule) for rule, bad in rules.items()]
    table = stored(df.observe(seen, *counts), name)
    found = seen.get
    return table, local_rows(df.sparkSession, [(rule, int(found[rule])) for rule in rules], RULE_SCHEMA)


def required(df: DataFrame, rules: dict[str, Column], name: str) -> DataFrame:
    """The stored table, or an error with every rule that a row breaks."""
    table, report = checked(df, rules, name)
    assert_clean(report)
    return table


def prediction_rules(predictions: Sequence[str]) -> dict[str, Column]:
    return {f"{p} finite": ~is_finite(p) for p in predictions}


def cut_rules(cuts: DataFrame, lives: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Cuts beside the life of their entity, and the rules: the entity is known and was observed up to the cut."""
    joined = cuts.join(lives.select(ENTITY, "last_cycle"), ENTITY, "left")
    unknown = F.col("last_cycle").isNull()
    inside = F.col("cut").between(1, F.col("last_cycle"))
    return joined, {"cut of a known entity": unknown, "cut within the life": ~unknown & ~inside}


def with_truth(endpoints: DataFrame, labelled: DataFrame, truth: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Endpoints with the truth of their entity and cycle, and the rules: each has one, and one alone."""
    known = labelled.groupBy(ENTITY, CYCLE).agg(F.count(F.lit(1)).alias("_truths"), *[F.first(t).alias(t) for t in truth])
    joined = endpoints.join(known, [ENTITY, CYCLE], "left")
    none = F.col("_truths").isNull()
    return joined, {"endpoint has a truth": none, "one truth an endpoint": ~none & (F.col("_truths") > 1)}


def distribution_cells(
    distribution: DataFrame, cell: Sequence[str], *, value: str = "value", support: tuple[float, float] | None = None, tolerance: float = 1e-12
) -> tuple[DataFrame, dict[str, Column]]:
    """A row per cell of a discrete distribution, and the rules: masses are finite, none is negative, they sum to one, and values lie in the support."""
    p, x = F.col("probability"), F.col(value)
    outside = ~x.between(*support) | ~is_finite(value) if support else ~is_finite(value)
    cells = distribution.groupBy(*cell).agg(
        F.sum(F.when(is_finite("probability"), p)).alias("mass"),
        F.count_if(~is_finite("probability")).alias("_odd"),
        F.count_if(p < 0).alias("_negative"),
        F.count_if(F.coalesce(outside, F.lit(True))).alias("_outside"),
    )
    rules = {
        "masses finite": F.col("_odd") > 0,
        "no negative mass": F.col("_negative") > 0,
        "mass sums to one": F.abs(F.col("mass") - 1.0) > tolerance,
        "values within the support": F.col("_outside") > 0,
    }
    return cells, rules


def multiplicity_cells(distribution: DataFrame, cell: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """A row per cell with its whole multiplicities, and the rule that they sum to the number of subsets."""
    cells = distribution.groupBy(*cell).agg(F.sum("multiplicity").alias("subsets"), F.max("combination_count").alias("combination_count"))
    return cells, {"multiplicities sum to the subset count": F.coalesce(F.col("subsets") != F.col("combination_count"), F.lit(True))}


def column_rules(panel: DataFrame, keys: Sequence[str] = (ENTITY, CYCLE)) -> DataFrame:
    """(rule, n_bad) of a raw panel's columns: keys and settings are there, and nothing but these and sensors."""
    missing = {*keys, *SETTINGS} - set(panel.columns)
    extra = set(panel.columns) - {*keys, *SETTINGS, *SENSORS}
    return local_rows(panel.sparkSession, [("panel columns present", len(missing)), ("no columns outside the panel contract", len(extra))], RULE_SCHEMA)
