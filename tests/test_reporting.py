import numpy as np
import pytest

from panelcal.operators import reporting
from panelcal.sources import integrity

SCHEMA = "model string, metric string, seed int, run_id string, value double"


def test_a_pending_value_makes_its_group_pending(spark):
    rows = spark.createDataFrame([("m", "x", 1, "b", 1.0), ("m", "x", 2, "a", None), ("m", "y", 1, "a", 1.0), ("m", "y", 2, "b", 4.0)], SCHEMA)
    got = {r.metric: r for r in reporting.summarise(rows, ["model", "metric"]).collect()}
    pending, full = got["x"], got["y"]
    assert (pending["mean"], pending.sample_std, pending.minimum, pending.maximum) == (None, None, None, None)
    assert (pending.n_seeds, pending.n_numeric_values, pending.metric_status) == (2, 1, "pending")
    assert full["mean"] == 2.5 and full.sample_std == pytest.approx(np.std([1, 4], ddof=1)) and full.run_ids == "a|b"


def test_stored_metrics_are_checked(spark):
    schema = "model string, value double"
    stored = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], schema)
    again = spark.createDataFrame([("a", 1.0 + 1e-13), ("b", 1.0 + 1e-9), ("d", 3.0)], schema)
    got = {r.model: r.stored_metric_match for r in reporting.verify_stored(stored, again, ["model"]).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_count_contract(spark):
    tables = {"a": spark.range(3), "b": spark.range(2)}
    got = {r.table: r.ok for r in reporting.count_contract(tables, {"a": 3, "b": 5}).collect()}
    assert got == {"a": True, "b": False}


def test_matrix_gaps(spark):
    want = integrity.expected_matrix(spark, "e", ["t"], ["c"], [1, 2])
    actual = spark.createDataFrame([("e", "t", "c", 1), ("e", "t", "c", 1), ("e", "t", "c", 3)], "experiment string, target string, condition string, seed bigint")
    got = {(r.seed, r.state) for r in integrity.matrix_gaps(actual, want, ["experiment", "target", "condition", "seed"]).collect()}
    assert got == {(2, "missing"), (3, "unexpected"), (1, "duplicate")}
