import pytest
from pyspark.sql import functions as F

from panelcal.operators import labels, quality, split
from panelcal.plans.workloads import Design, grid_table
from panelcal.schema import ContractError


def keys(spark, entities, cycles):
    return spark.range(1, entities + 1).crossJoin(spark.range(1, cycles + 1).withColumnRenamed("id", "cycle")).select(
        F.col("id").alias("entity_id"), "cycle"
    )


def test_capped_labels(spark):
    got = labels.add_labels(keys(spark, 2, 3), cap=2).orderBy("entity_id", "cycle").collect()
    assert [r.rul_capped for r in got] == [2, 1, 0, 2, 1, 0]
    with pytest.raises(ContractError):
        labels.add_labels(keys(spark, 1, 1), cap=0)


def test_terminal_rule_finds_bad_labels(spark):
    bad = keys(spark, 2, 3).withColumn("rul_raw", F.col("cycle") - 2)
    report = {r.rule: r.n_bad for r in quality.terminal_labels(bad).collect()}
    assert report == {"label not negative": 2, "terminal label is zero": 2}
    with pytest.raises(ContractError, match="terminal label"):
        quality.assert_clean(quality.terminal_labels(bad))


def test_roles_counts_and_coverage(spark):
    ids = keys(spark, 103, 1)
    roles = split.assign_roles(ids, (13, 37))
    counts = {(r.seed, r.role): r["count"] for r in roles.groupBy("seed", "role").count().collect()}
    for seed in (13, 37):
        assert (counts[seed, split.TRAIN], counts[seed, split.CALIBRATION], counts[seed, split.VALIDATION]) == (61, 20, 22)
    quality.assert_clean(quality.role_rules(roles, ids))
    a = {(r.seed, r.entity_id): r.role for r in roles.collect()}
    b = {(r.seed, r.entity_id): r.role for r in split.assign_roles(ids.repartition(9), (13, 37)).collect()}
    assert a == b


def test_too_few_entities_fail(spark):
    with pytest.raises(Exception, match="at least 5 entities"):
        split.assign_roles(keys(spark, 4, 1), (13,)).collect()
    with pytest.raises(ContractError):
        split.assign_roles(keys(spark, 9, 1), (13,), train_fraction=0.8, calibration_fraction=0.2)
    with pytest.raises(ContractError):
        split.assign_roles(keys(spark, 9, 1), (-1,))


def test_cut_range_and_prefixes(spark):
    panel = keys(spark, 2, 100)
    grid = grid_table(panel, Design(seeds=(13, 37)))
    cuts = split.cut_points(labels.last_cycles(panel), grid)
    rows = cuts.collect()
    assert len(rows) == 4 and all(40 <= r.cut <= 90 for r in rows)
    assert sorted(rows) == sorted(split.cut_points(labels.last_cycles(panel.repartition(3)), grid).collect())
    prefix = split.restrict_to_cuts(panel, cuts.filter("seed = 13"))
    ends = labels.endpoints(prefix.select("entity_id", "cycle", "cut"))
    assert all(r.cycle == r.cut for r in ends.collect())
    short = keys(spark, 1, 31)
    with pytest.raises(Exception, match="no valid cut-point range"):
        split.cut_points(labels.last_cycles(short), grid).collect()
    assert split.cut_points(labels.last_cycles(short), grid, strict=False).count() == 0


def test_quality_counts_nan_infinity_and_fractions(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (1.5, float("nan")), (-1.0, float("inf")), (None, None)], "id double, x double"
    )
    report = {r.rule: r.n_bad for r in quality.check(df, quality.row_rules(["id"], ["x"])).collect()}
    assert report == {"id positive integer": 3, "x finite": 3}
