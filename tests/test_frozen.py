import pytest
from pyspark.sql import functions as F

from panelcal.operators import models
from panelcal.plans.frozen import FrozenConformal, freeze
from panelcal.schema import ContractError

FEATURES = ["sensor_1", "cycle_index"]


def rows(spark, n, shift=0.0):
    return spark.range(1, n + 1).select(
        F.col("id").alias("entity_id"),
        (F.col("id") % 17 + shift).cast("double").alias("sensor_1"),
        (F.col("id") % 5).cast("double").alias("cycle_index"),
        (F.col("id") % 17 * 3 + F.col("id") % 3).alias("rul_capped"),
    )


def fitted(spark):
    train = rows(spark, 80)
    return [models.fit_mean(train), models.fit_ridge(train, FEATURES), models.fit_boosting(train, FEATURES, iterations=2, depth=2, min_rows=1)]


def test_saved_and_loaded_gives_the_same_intervals_without_a_fit(spark, tmp_path, monkeypatch):
    frozen = freeze(fitted(spark), rows(spark, 30), FEATURES, cap=125, alphas=(0.1, 0.01))
    frozen.save(spark, f"{tmp_path}/frozen")
    for name in ("fit_mean", "fit_ridge", "fit_boosting", "fit_point_models"):
        monkeypatch.setattr(models, name, lambda *a, **k: pytest.fail("a fit"))
    target = rows(spark, 50, shift=4.0).drop("rul_capped")
    key = ["model", "alpha", "entity_id"]
    before, after = (x.apply(target).orderBy(*key).collect() for x in (frozen, FrozenConformal.load(spark, f"{tmp_path}/frozen")))
    assert before == after and len(after) == 50 * 3 * 2
    tenth = [r for r in after if r.alpha == 0.1]
    assert all(r.upper - r.lower == pytest.approx(2 * r.quantile) and r.n_cal == 30 for r in tenth)
    assert all(r.quantile == float("inf") and not r.finite_rank_attainable for r in after if r.alpha == 0.01)


def test_other_columns_are_refused(spark):
    frozen = freeze(fitted(spark)[:1], rows(spark, 30), FEATURES, cap=125)
    with pytest.raises(ContractError):
        frozen.apply(rows(spark, 5).select("entity_id", "sensor_1"))
    with pytest.raises(ContractError):
        frozen.apply(rows(spark, 5))
    with pytest.raises(ContractError):
        freeze([], rows(spark, 30), FEATURES, cap=125)


def test_an_infinite_feature_fails(spark):
    bad = rows(spark, 10).withColumn("sensor_1", F.when(F.col("entity_id") == 3, float("inf")).otherwise(F.col("sensor_1")))
    with pytest.raises(Exception, match="features must be finite"):
        models.fit_boosting(bad, FEATURES, iterations=1)
