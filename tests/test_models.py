import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcal.operators import models, regimes, weights
from panelcal.schema import ContractError


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=["sensor_1", "sensor_2", "sensor_3"])
    pdf["rul_capped"] = np.clip(60 + 20 * pdf.sensor_1 - 9 * pdf.sensor_2 + rng.normal(size=n), 0, 125).round()
    pdf["entity_id"] = np.arange(n)
    return pdf, spark.createDataFrame(pdf)


def test_ridge_equals_the_closed_form(table):
    pdf, df = table
    names = ["sensor_1", "sensor_2", "sensor_3"]
    x = pdf[names].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    y = pdf.rul_capped.to_numpy()
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    want = y.mean() + z @ w
    got = models.fit_ridge(df, names).predict(df).orderBy("entity_id").toPandas().pred_raw
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_constant_feature_and_label(table):
    _, df = table
    flat = df.withColumn("sensor_3", F.lit(2.0))
    assert models.fit_ridge(flat, ["sensor_1", "sensor_3"]).predict(flat).filter("isnan(pred_raw)").count() == 0
    level = df.withColumn("rul_capped", F.lit(7.0))
    assert models.fit_ridge(level, ["sensor_1"]).predict(level).first().pred_raw == 7.0


def test_missing_labels_fail(table):
    _, df = table
    with pytest.raises(Exception, match="labels must be finite"):
        models.checked_training(df.withColumn("rul_capped", F.lit(float("nan"))), ["sensor_1"], "rul_capped").collect()


def test_boosting_beats_the_mean_and_keeps_inputs(table):
    pdf, df = table
    fitted = models.fit_point_models(df, ["sensor_1", "sensor_2", "sensor_3"], boosting={"iterations": 5, "depth": 3, "step": 0.5})
    out = models.predict_long(fitted, df, ["entity_id", "rul_capped"])
    assert out.count() == 3 * len(pdf)
    error = {r.model: r.e for r in out.groupBy("model").agg(F.avg(F.abs(F.col("pred_raw") - F.col("rul_capped"))).alias("e")).collect()}
    assert error["hist_gradient_boosting"] < error["mean"] and error["ridge"] < error["mean"]


def test_leaf_quantiles_never_cross(table):
    _, df = table
    fitted = models.fit_leaf_quantiles(df, ["sensor_1", "sensor_2"], [0.05, 0.5, 0.95], trees=3, depth=3)
    out = fitted.predict(df, ["entity_id", "rul_capped"]).select("rul_capped", *[F.col("quantiles")[i].alias(f"q{i}") for i in range(3)])
    assert out.filter("q0 > q1 OR q1 > q2").count() == 0
    inside = out.agg(F.avg(F.col("rul_capped").between(F.col("q0"), F.col("q2")).cast("int"))).first()[0]
    assert 0.8 < inside <= 1


def newton(x, y, c, steps=50):
    design = np.c_[x, np.ones(len(x))]
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = penalty @ w + c * design.T @ (p - y)
        w -= np.linalg.solve(penalty + c * (design * (p * (1 - p))[:, None]).T @ design, gradient)
    return w


def test_density_ratio_equals_newton(spark):
    rng = np.random.default_rng(9)
    names = ["op_setting_1", "op_setting_2", "op_setting_3"]
    a, b = rng.normal(size=(120, 3)), rng.normal(size=(60, 3)) + [0.7, 0, -0.3]
    source, target = spark.createDataFrame(pd.DataFrame(a, columns=names)), spark.createDataFrame(pd.DataFrame(b, columns=names))
    both = np.r_[a, b]
    z = (both - both.mean(0)) / both.std(0)
    w = newton(z, np.r_[np.zeros(120), np.ones(60)], 1.0)
    p = 1 / (1 + np.exp(-(z @ w[:3] + w[3])))
    want = p / (1 - p) * 120 / 60
    rated_source, rated_target, fit = weights.density_ratios(source, target)
    got = np.r_[rated_source.toPandas().ratio, rated_target.toPandas().ratio]
    np.testing.assert_allclose(np.sort(got), np.sort(want), rtol=1e-5)
    assert (fit["source_count"], fit["target_count"]) == (120, 60)


def test_regimes_and_fallbacks(spark):
    rng = np.random.default_rng(1)
    base = np.repeat([[0.0, 0, 0], [10, 0, 5], [20, 9, 0]], 40, axis=0) + rng.normal(size=(120, 3)) * 0.01
    pdf = pd.DataFrame(base, columns=["op_setting_1", "op_setting_2", "op_setting_3"])
    pdf["sensor_1"] = rng.normal(size=120) + np.repeat([0, 50, 100], 40)
    features = list(pdf.columns)
    df = spark.createDataFrame(pdf)
    fitted = regimes.fit_regime_scaler(df, features)
    assert fitted.n_regimes == 3 and fitted.fallback_reason is None
    out = fitted.transform(df)
    stats = out.groupBy("regime").agg(F.avg("sensor_1").alias("m"), F.stddev_pop("sensor_1").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in stats)
    flat = df.withColumns({c: F.lit(1.0) for c in features[:3]})
    single = regimes.fit_regime_scaler(flat, features)
    assert (single.n_regimes, single.fallback_reason) == (1, "single_distinct_setting")
    assert single.transform(flat).agg(F.max(F.abs("op_setting_1"))).first()[0] == 0.0
    with pytest.raises(ContractError):
        regimes.fit_regime_scaler(df, [*features, "entity_id"])
    with pytest.raises(ContractError):
        fitted.transform(df.drop("sensor_1"))
    assert regimes.choose_regimes({2: 0.5, 3: 0.7, 4: 0.7}) == 3 and regimes.choose_regimes({}) is None


def test_a_written_regime_scaler_reads_back_bit_for_bit(spark, tmp_path):
    from panelcal.operators.regimes import RegimeScaling, RegimeScalingModel, fit_regime_scaler

    rows = spark.createDataFrame(
        [(10.0 * (i % 3) + (i * 37 % 11) / 11, float(i % 2), 1.0, (i * 53 % 17) / 17 * (1 + i % 3), 4.0, i) for i in range(300)],
        "op_setting_1 double, op_setting_2 double, op_setting_3 double, sensor_1 double, sensor_2 double, entity_id long",
    )
    features = ["sensor_1", "sensor_2"]
    fitted = RegimeScaling(featureCols=features, keepCols=["entity_id"], nRegimes=3).fit(rows)
    fitted.write().save(f"{tmp_path}/scaler")
    read = RegimeScalingModel.load(f"{tmp_path}/scaler")
    assert read.scaler == fitted.scaler == fit_regime_scaler(rows, features, n_regimes=3) and read.scaler.n_regimes == 3
    before, after = (m.transform(rows).orderBy("entity_id").collect() for m in (fitted, read))
    assert before == after and len({r.regime for r in after}) == 3
    one = RegimeScaling(featureCols=features).fit(rows.withColumn("op_setting_1", F.lit(1.0)).withColumn("op_setting_2", F.lit(1.0)))
    one.write().save(f"{tmp_path}/one")
    assert RegimeScalingModel.load(f"{tmp_path}/one").scaler.fallback_reason == "single_distinct_setting"


def test_density_ratios_run_in_a_session_with_tags_and_observations(spark):
    """The plan must not carry the fitted model: its training summary holds the session, which these make unserialisable."""
    from pyspark.sql import Observation

    rows = spark.range(60).selectExpr("id AS entity_id", "cast(id % 7 AS double) AS op_setting_1", "cast(id % 3 AS double) AS op_setting_2", "1.0D AS op_setting_3")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).count()
    spark.addTag("rated")
    try:
        source, target, fit = weights.density_ratios(rows.where("entity_id % 4 > 0"), rows.where("entity_id % 4 = 0"))
        found = source.unionByName(target).collect()
    finally:
        spark.removeTag("rated")
    z = [[(r[f"op_setting_{i + 1}"] - m) / s for i, (m, s) in enumerate(fit["scaling"].values())] for r in found]
    odds = np.exp(np.array(z) @ fit["coefficients"] + fit["intercept"]) * 45 / 15
    assert seen.get["n"] == len(found) == 60
    np.testing.assert_allclose([r.ratio for r in found], odds, rtol=1e-12)


def test_regimes_are_searched_over_distinct_settings_whatever_the_order(spark):
    """Each k passed over every row, and the fit followed the order in which the rows were read."""
    cells = [(float(i % 4) * 3 + (i % 4 > 1), float(i % 3), 1.0, float(i * 31 % 17)) for i in range(1200)]
    schema = "op_setting_1 double, op_setting_2 double, op_setting_3 double, sensor_1 double"
    one, other = spark.createDataFrame(cells, schema).coalesce(1), spark.createDataFrame(cells[::-1], schema).repartition(7)
    seen = []
    real = regimes.cut
    regimes.cut = lambda df: seen.append(real(df)) or seen[-1]
    try:
        a, b = (regimes.fit_regime_scaler(rows, ["sensor_1"]) for rows in (one, other))
    finally:
        regimes.cut = real
    assert [v.count() for v in seen] == [12, 12] and seen[0].agg(F.sum("_w")).first()[0] == 1200.0
    assert a.n_regimes == b.n_regimes
    np.testing.assert_allclose(a.centres, b.centres, atol=1e-9)
    # The weighted silhouette is that of all rows.
    for k, s in a.silhouettes.items():
        assert -1 <= s <= 1 and s == pytest.approx(b.silhouettes[k], abs=1e-9)
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    z = one.withColumns({c: (F.col(c) - m) / s for c, (m, s) in a.setting_scaling.items()})
    placed = regimes.assign_nearest(z, a.centres, a.settings)
    labelled = VectorAssembler(inputCols=list(a.settings), outputCol="_x").transform(placed)
    whole = ClusteringEvaluator(featuresCol="_x", predictionCol="regime", metricName="silhouette").evaluate(labelled)
    assert whole == pytest.approx(a.silhouettes[a.n_regimes], abs=1e-9)


def test_features_are_derived_for_rows_in_reach_only_and_change_nothing(spark):
    """The shift matrix made the features of every row, of which it reads a sixth; an entity with gaps keeps its rows up to the cut."""
    from panelcal.operators.features import temporal_features
    from panelcal.plans.workloads import Design, model_predictor, shift_matrix

    cells = [(e, c + (c > 25 and e % 5 == 0), float((e * 31 + c * c * 17) % 23)) for e in range(1, 61) for c in range(1, 91)]
    panel = spark.createDataFrame(cells, "entity_id long, cycle long, sensor_1 double").withColumn(
        "domain", F.when(F.col("entity_id") % 3 == 0, "A").otherwise("B")
    )
    panel = panel.withColumns({f"op_setting_{i}": F.col("cycle") % (i + 1) * 1.0 for i in (1, 2, 3)})
    design = Design(seeds=(13, 37), alphas=(0.4,), policy="infinite", domains=("A", "B"))
    names, seen = ["sensor_1", "sensor_1_delta_1", "sensor_1_rolling_mean_20", "sensor_1_rolling_slope_20", "cycle_index"], []
    predictor, source = model_predictor(names, only=("mean", "ridge")), F.col("domain") == "A"

    def derive(rows):
        seen.append(rows.count())
        return temporal_features(rows, ["sensor_1"], carry=("domain",), with_next=True)

    whole = shift_matrix(temporal_features(panel, ["sensor_1"], carry=("domain",), with_next=True), design, predictor, source)
    near = shift_matrix(panel, design, predictor, source, derive=derive)
    keys = ["seed", "domain", "model", "entity_id", "cycle", "lower", "upper"]
    a, b = (sorted(map(tuple, x.select(*keys).collect())) for x in (whole, near))
    assert len(a) == len(b) > 100 and [x[:5] for x in a] == [x[:5] for x in b]
    np.testing.assert_allclose([x[5:] for x in a], [x[5:] for x in b], atol=1e-6)
    assert 0 < seen[0] < 0.7 * panel.count()
