import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcal.operators import conformal, metrics
from panelcal.schema import ContractError


def scores(spark, values, cell="a"):
    return spark.createDataFrame([(cell, float(v)) for v in values], "cell string, score double")


def one(spark, values, alpha, policy="raise"):
    return conformal.calibrate(scores(spark, values), ["cell"], [alpha], policy=policy).first()


def test_literal_ranks(spark):
    assert (one(spark, (1, 2, 5), 0.5).quantile, one(spark, (1, 2, 5), 0.5).regime) == (2.0, "interior")
    assert (one(spark, (1, 2, 5), 0.25).quantile, one(spark, (1, 2, 5), 0.25).regime) == (5.0, "max_statistic")
    with pytest.raises(Exception, match="unattainable"):
        one(spark, (1, 2, 5), 0.1)
    row = one(spark, (1, 2, 5), 0.1, "infinite")
    assert row.quantile == float("inf") and row.effective_rank is None and not row.finite_rank_attainable
    row = one(spark, (1, 2, 5), 0.1, "legacy_max_clamp")
    assert (row.quantile, row.requested_rank, row.effective_rank, row.regime) == (5.0, 4, 3, "finite_quantile_unattainable")


def test_bad_scores_and_parameters_fail(spark):
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite and nonnegative"):
            one(spark, (1, bad, 2), 0.5)
    with pytest.raises(ContractError):
        one(spark, (1, 2), 1.0)
    with pytest.raises(ContractError):
        one(spark, (1, 2), 0.5, "other")


def test_many_cells_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(f"c{i}", float(v)) for i in range(4) for v in np.round(rng.exponential(size=50 + 37 * i), 2)]
    df = spark.createDataFrame(data, "cell string, score double").repartition(5)
    for r in conformal.calibrate(df, ["cell"], (0.05, 0.1, 0.5)).collect():
        values = np.sort([v for c, v in data if c == r.cell])
        rank = int(np.ceil((len(values) + 1) * (1.0 - r.alpha)))
        assert (r.quantile, r.requested_rank, r.n_cal) == (values[rank - 1], rank, len(values))


def test_split_interval_and_interval_score(spark):
    cal = spark.createDataFrame([("a", abs(10.0 - 9.0)), ("a", abs(12.0 - 13.0))], "cell string, score double")
    q = conformal.calibrate(cal, ["cell"], [0.5])
    out = conformal.symmetric_intervals(spark.createDataFrame([("a", 11.0)], "cell string, pred double"), q, ["cell"]).first()
    assert (out.quantile, out.lower, out.upper) == (1.0, 10.0, 12.0)
    rows = spark.createDataFrame(
        [(1, 0.0, 1.0, 3.0, 0.1), (2, 10.0, 8.0, 9.0, 0.1)], "entity_id int, y_true double, lower double, upper double, alpha double"
    )
    m = metrics.interval_metrics(rows, [], scale=125).first()
    assert (m.coverage, m.mean_width, m.normalized_interval_score) == (0.0, 1.5, pytest.approx(21.5 / 125))


def test_bands_never_shrink_and_crossing_fails(spark):
    rows = spark.createDataFrame(
        [(0.25, 5, 4.0, 6.0), (0.25, 9, 4.0, 6.0), (0.25, 1, 4.0, 6.0)], "alpha double, rul_capped int, band_lower double, band_upper double"
    )
    scored = conformal.band_scores(rows)
    assert sorted(r.score for r in scored.collect()) == [0.0, 3.0, 3.0]
    q = conformal.calibrate_bands(scored, ["alpha"])
    out = conformal.band_intervals(rows.limit(1), q, ["alpha"]).first()
    assert (out.lower, out.upper) == (1.0, 9.0)
    with pytest.raises(Exception, match="lower band above"):
        conformal.band_scores(rows.withColumn("band_lower", F.lit(7.0))).collect()


def brute_weighted(values, weights, own, alpha):
    order = np.argsort(values, kind="stable")
    total = np.cumsum(np.asarray(weights, float)[order])
    at = int(np.searchsorted(total, (1 - alpha) * (np.sum(weights) + own)))
    return float("inf") if at == len(order) else float(np.asarray(values, float)[order[at]])


@pytest.mark.parametrize("bounded", [True, False])
def test_weighted_quantiles(spark, bounded):
    cases = [((1, 2, 5), (1, 1, 1), 1, 0.3), ((1, 2, 5), (10, 1, 1), 1, 0.5), ((1, 2, 5), (1, 1, 1), 100, 0.3), ((1, 2, 3), (1, 1, 1), 0.01, 0.5)]
    want = [5.0, 1.0, float("inf"), 2.0]
    for (values, weights, own, alpha), expected in zip(cases, want, strict=True):
        assert brute_weighted(values, weights, own, alpha) == expected
        cal = spark.createDataFrame([("a", float(v), float(w)) for v, w in zip(values, weights, strict=True)], "cell string, score double, weight double")
        tgt = spark.createDataFrame([("a", 1, float(own))], "cell string, entity_id int, weight double")
        out = conformal.weighted_quantiles(cal, tgt, ["cell"], [alpha], bounded=bounded, require_finite=False, slices=4)
        assert out.first().quantile == expected
    with pytest.raises(Exception, match="infinite"):
        tgt = spark.createDataFrame([("a", 1, 100.0)], "cell string, entity_id int, weight double")
        conformal.weighted_quantiles(cal, tgt, ["cell"], [0.3], bounded=bounded, slices=4).collect()


def test_weight_bounds_divide_before_clipping_targets(spark):
    cal = spark.createDataFrame([("a", 0.01), ("a", 4.0)], "cell string, ratio double")
    tgt = spark.createDataFrame([("a", 30.0), ("a", 1.0)], "cell string, ratio double")
    c, t = conformal.bounded_weights(cal, tgt, ["cell"], clip_min=0.1, clip_max=10.0)
    assert [r.weight for r in c.orderBy("ratio").collect()] == [pytest.approx(0.1 / 2.05), pytest.approx(4 / 2.05)]
    assert [r.weight for r in t.orderBy("ratio").collect()] == [pytest.approx(1 / 2.05), 10.0]


def test_point_metrics_and_pending_overflow(spark):
    rows = spark.createDataFrame([("a", 10.0, 8.0), ("a", 10.0, 13.0), ("b", 0.0, 1e6)], "cell string, y_true double, pred double")
    got = {r.cell: r for r in metrics.point_metrics(rows, ["cell"]).collect()}
    assert got["a"].rmse == pytest.approx(np.sqrt(6.5)) and got["a"].signed_error == 0.5
    assert got["a"].nasa_score == pytest.approx(np.exp(2 / 13) - 1 + np.exp(0.3) - 1)
    assert got["b"].nasa_score is None and got["b"].metric_status == "nonfinite_on_raw_support"


def test_evaluation_needs_one_row_per_entity(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 1, 1.0, 2.0)], "cell string, entity_id int, y_true double, pred double")
    with pytest.raises(Exception, match="more than one row"):
        metrics.evaluate_endpoints(rows, ["cell"]).collect()


def test_bootstrap_modes_agree_and_are_deterministic(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=80)
    rows = spark.createDataFrame(
        [("a", 13, i, float(v), -1.0, 1.0, 0.25) for i, v in enumerate(y)],
        "cell string, seed int, entity_id bigint, y_true double, lower double, upper double, alpha double",
    )
    found = {}
    for mode in ("multinomial", "poisson"):
        def run(df, mode=mode):
            found = metrics.bootstrap_intervals(df, ["cell"], scale=125, resamples=300, mode=mode)
            # The order of partial sums may move the last bit.
            ends = [F.round(c, 9).alias(c) for c in ("bootstrap_ci_lower", "bootstrap_ci_upper")]
            return sorted(found.select("metric", *ends).collect())

        found[mode] = run(rows)
        assert found[mode] == run(rows.repartition(6))
    point = float(np.mean(np.abs(y) <= 1))
    for rows_ in found.values():
        cover = next(r for r in rows_ if r.metric == "coverage")
        assert cover.bootstrap_ci_lower < point < cover.bootstrap_ci_upper
    for a, b in zip(found["multinomial"], found["poisson"], strict=True):
        assert a.bootstrap_ci_lower == pytest.approx(b.bootstrap_ci_lower, abs=0.05)


def test_multinomial_draws_are_never_broadcast(spark, monkeypatch):
    """Cells look small to Spark, their draws are not: only the rows may be broadcast, and both ways of the join agree."""
    rows = [("a" if i % 3 else "b", i, float(i % 7), 2.0, 4.0 + i % 2, 0.25, 13) for i in range(90)]
    df = spark.createDataFrame(rows, "cell string, entity_id long, y_true double, lower double, upper double, alpha double, seed int")
    found = {}
    for limit, join in ((250_000, "BroadcastHashJoin"), (10, "SortMergeJoin")):
        monkeypatch.setattr(metrics, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(metrics, "DRAW_BLOCK", 16)
        out = metrics.bootstrap_intervals(df, ["cell"], scale=125, resamples=50, mode="multinomial")
        plan = out._jdf.queryExecution().executedPlan().toString()
        line = next(x for x in plan.splitlines() if "Join" in x and "_at#" in x)
        assert join in line and ("BuildLeft" not in line), line
        found[limit] = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.collect())
    assert found[10] == found[250_000] and len(found[10]) == 6
