import pytest
from pyspark.sql import functions as F

from panelcal.operators import gates
from panelcal.operators.quality import interval_rules
from panelcal.schema import ContractError


def report(pair):
    return {r.rule: r.n_bad for r in gates.checked(*pair, "t")[1].collect()}


def test_a_table_is_handed_on_only_without_bad_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (2, 2.0, 1.0), (3, None, 1.0), (4, float("inf"), 1.0)], "id int, lower double, upper double")
    table, found = gates.checked(rows, interval_rules(), "t")
    assert {r.rule: r.n_bad for r in found.collect()} == {"bounds finite": 2, "lower not above upper": 3}
    assert table.count() == 4
    with pytest.raises(ContractError, match="bounds finite: 2; lower not above upper: 3"):
        gates.required(rows, interval_rules(), "t")
    assert gates.required(rows.filter("id = 1"), interval_rules(), "t").count() == 1
    assert gates.required(rows.limit(0), interval_rules(), "t").count() == 0


def test_counts_ride_on_the_write(spark):
    """The rows are computed once: an accumulator in the plan sees each of them once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def touched(x):
        seen.add(1)
        return x

    rows = spark.range(50).select(touched("id").alias("id")).withColumn("pred", F.col("id").cast("double"))
    assert report((rows, gates.prediction_rules(["pred"]))) == {"pred finite": 0}
    assert seen.value == 50


def test_cuts_truths_and_masses(spark):
    lives = spark.createDataFrame([(1, 9), (2, 4)], "entity_id long, last_cycle long")
    cuts = spark.createDataFrame([(1, 9), (1, 10), (2, 0), (3, 1)], "entity_id long, cut long")
    assert report(gates.cut_rules(cuts, lives)) == {"cut of a known entity": 1, "cut within the life": 2}
    labelled = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (1, 2, 4)], "entity_id long, cycle long, y int")
    ends = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "entity_id long, cycle long")
    assert report(gates.with_truth(ends, labelled, ["y"])) == {"endpoint has a truth": 1, "one truth an endpoint": 1}
    masses = [("a", 0.0, 0.5), ("a", 1.0, 0.5), ("b", 0.5, 1.5), ("b", 2.0, -0.5), ("c", 0.1, None), ("d", None, 0.4)]
    rows = spark.createDataFrame(masses, "k string, value double, probability double")
    assert report(gates.distribution_cells(rows, ["k"], support=(0.0, 1.0))) == {
        "masses finite": 1, "no negative mass": 1, "mass sums to one": 2, "values within the support": 2
    }
    subsets = spark.createDataFrame([("a", 2, 5), ("a", 3, 5), ("b", 1, 5), ("c", None, 5)], "k string, multiplicity long, combination_count long")
    assert report(gates.multiplicity_cells(subsets, ["k"])) == {"multiplicities sum to the subset count": 2}


def test_raw_columns(spark):
    panel = spark.range(1).selectExpr("id as entity_id", "id as cycle", "0D as op_setting_1", "0D as op_setting_2", "0D as sensor_3", "'x' as site")
    assert {r.rule: r.n_bad for r in gates.column_rules(panel).collect()} == {"panel columns present": 1, "no columns outside the panel contract": 1}
