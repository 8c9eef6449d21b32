import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcal.operators.features import (
    TemporalFeatures,
    TemporalFeaturesModel,
    feature_names,
    kept_sensors,
    sensor_variances,
    temporal_features,
)
from panelcal.schema import ContractError
from panelcal.streaming.features import window_values

SETTINGS = ("op_setting_1", "op_setting_2", "op_setting_3")


def panel(spark, rows, sensors=1):
    cols = ", ".join(f"sensor_{i + 1} double" for i in range(sensors))
    full = [(e, c, 0.0, 0.0, 0.0, *map(float, v)) for e, c, *v in rows]
    return spark.createDataFrame(full, f"entity_id bigint, cycle bigint, {', '.join(s + ' double' for s in SETTINGS)}, {cols}")


def test_literal_window_values(spark):
    rows = [(1, i + 1, v) for i, v in enumerate((1, 2, 4, 8))] + [(2, 1, 10), (2, 2, 11)]
    got = {(r.entity_id, r.cycle): r for r in temporal_features(panel(spark, rows), ["sensor_1"], windows=(3,)).collect()}
    third = got[1, 3]
    assert third.sensor_1_rolling_std_3 == pytest.approx(np.std([1, 2, 4]))
    assert third.sensor_1_rolling_slope_3 == pytest.approx(1.5)
    first = got[2, 1]
    assert (first.sensor_1_delta_1, first.sensor_1_rolling_mean_3, first.sensor_1_rolling_std_3, first.sensor_1_rolling_slope_3) == (0, 10, 0, 0)


def test_constant_sensor_is_dropped(spark):
    df = panel(spark, [(e, c, 10 * e + c, 3) for e in (1, 2) for c in (1, 2, 3, 4)], 2)
    keep = {r.sensor: r.keep for r in kept_sensors(sensor_variances(df, ["sensor_1", "sensor_2"])).collect()}
    assert keep == {"sensor_1": True, "sensor_2": False}


def test_prefix_invariance(spark):
    rng = np.random.default_rng(1)
    rows = [(e, c, rng.normal()) for e in (1, 2) for c in range(1, 31)]
    df = panel(spark, rows)
    full = temporal_features(df, ["sensor_1"]).filter("cycle <= 12").orderBy("entity_id", "cycle").collect()
    part = temporal_features(df.filter("cycle <= 12"), ["sensor_1"]).orderBy("entity_id", "cycle").collect()
    assert full == part


@pytest.mark.parametrize("chunk", [1, 7, 40])
def test_chunks_equal_the_plain_pass_even_with_gaps(spark, chunk):
    rng = np.random.default_rng(2)
    sparse = sorted(rng.choice(400, 60, replace=False) + 1)
    rows = [(1, int(c), rng.normal()) for c in sparse] + [(2, c, rng.normal()) for c in range(1, 20)]
    df = panel(spark, rows)
    plain = temporal_features(df, ["sensor_1"], with_next=True).orderBy("entity_id", "cycle").toPandas()
    cut = temporal_features(df, ["sensor_1"], with_next=True, chunk_cycles=chunk).orderBy("entity_id", "cycle").toPandas()
    assert len(plain) == len(cut)
    np.testing.assert_allclose(plain.fillna(-1).to_numpy(float), cut.fillna(-1).to_numpy(float), atol=1e-9)


def test_one_exchange_serves_all_windows(spark):
    df = panel(spark, [(e, c, c) for e in (1, 2) for c in range(1, 9)])
    plan = temporal_features(df, ["sensor_1"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_estimator_round_trip_and_schema_check(spark, tmp_path):
    df = panel(spark, [(e, c, 10 * e + c, 3) for e in (1, 2) for c in (1, 2, 3, 4)], 2)
    fitted = TemporalFeatures(sensorCols=["sensor_1", "sensor_2"], windows=[2, 3]).fit(df)
    fitted.save(str(tmp_path / "m"))
    again = TemporalFeaturesModel.load(str(tmp_path / "m"))
    assert again.getOrDefault("keptSensors") == ["sensor_1"]
    assert again.features == feature_names(["sensor_1"], windows=(2, 3))
    out = again.transform(df)
    assert out.count() == 8 and set(again.features) <= set(out.columns)
    with pytest.raises(ContractError):
        again.transform(df.withColumn("label", F.lit(1.0)))
    with pytest.raises(ContractError):
        TemporalFeatures(sensorCols=["sensor_2"]).fit(df)


def test_stream_values_equal_batch_formula(spark):
    history = np.array([1.0, 2.0, 4.0, 8.0, 3.0])
    df = panel(spark, [(1, i + 1, v) for i, v in enumerate(history)])
    row = temporal_features(df, ["sensor_1"], windows=(3, 5)).filter("cycle = 5").first()
    want = [row.sensor_1_delta_1] + [row[f"sensor_1_rolling_{s}_{w}"] for w in (3, 5) for s in ("mean", "std", "slope")]
    np.testing.assert_allclose(window_values(history, (3, 5)), want, atol=1e-12)


def test_windows_are_not_added_up_by_spark_and_nulls_take_no_part(spark):
    """Twenty rows were added up anew for each row and statistic; small batches must not show either."""
    values = [None if i % 4 == 1 else float(i * i % 11) for i in range(25)]
    df = panel(spark, [(e, i + 1, -1.0 if v is None else v) for e in (1, 2) for i, v in enumerate(values)]).withColumn("sensor_1", F.when(F.col("sensor_1") >= 0, F.col("sensor_1")))
    saved = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = temporal_features(df, ["sensor_1"], windows=(3, 5), with_next=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", saved)
    assert "regr_slope" not in plan and plan.count("Sort [") == 1
    assert len(rows) == 50
    for r in rows:
        now, before = values[r.cycle - 1], values[r.cycle - 2] if r.cycle > 1 else None
        assert r.sensor_1_delta_1 == (now - before if None not in (now, before) else 0.0)
        assert r.next_cycle == (r.cycle + 1 if r.cycle < 25 else None)
        for w in (3, 5):
            seen = [(i, v) for i, v in enumerate(values[: r.cycle]) if i > r.cycle - 1 - w and v is not None]
            x, y = np.array([p[0] for p in seen], float), np.array([p[1] for p in seen])
            want = [y.mean(), y.std(), np.polyfit(x, y, 1)[0] if len(x) > 1 else 0.0]
            got = [r[f"sensor_1_rolling_{s}_{w}"] for s in ("mean", "std", "slope")]
            np.testing.assert_allclose(got, want, atol=1e-9)
