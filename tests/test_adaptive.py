import numpy as np
import pytest

from panelcal.operators import adaptive
from panelcal.schema import ContractError


def brute(values, centers, truths, alpha0, gamma, low=0.001, high=0.999):
    values, alpha, out = np.sort(values), alpha0, []
    for c, y in zip(centers, truths, strict=True):
        rank = int(np.ceil((len(values) + 1) * (1 - alpha)))
        q = values[min(rank, len(values)) - 1]
        miss = bool(y < c - q or y > c + q)
        after = min(max(alpha + gamma * (alpha0 - miss), low), high)
        out.append((alpha, after, q, miss))
        alpha = after
    return out


def trace(spark, values, centers, truths, alpha, **options):
    scores = spark.createDataFrame([("m", float(v)) for v in values], "model string, score double")
    rows = [("m", "s", i, float(c), float(y)) for i, (c, y) in enumerate(zip(centers, truths, strict=True))]
    targets = spark.createDataFrame(rows, "model string, stream string, seq bigint, pred double, y_true double").repartition(3)
    out = adaptive.adaptive_trace(targets, scores, ["model"], ["model", "stream"], [alpha], slices=8, **options)
    return [(r.alpha_used, r.alpha_next, r.quantile, r.miss) for r in out.orderBy("seq").collect()]


def test_literal_step(spark):
    got = trace(spark, (1, 2, 3, 4), [10], [20], 0.10, gamma=0.01)
    assert got == [(0.10, pytest.approx(0.091), 4.0, True)]


def test_alpha_stays_in_bounds(spark):
    down = trace(spark, (1, 2, 3, 4), [0, 0], [50, 50], 0.5, gamma=1.0)
    up = trace(spark, (1, 2, 3, 4), [0, 0, 0], [0, 0, 0], 0.5, gamma=1.0)
    assert down[0][1] == 0.001 and up[1][1] == 0.999


def test_random_paths_with_ties_match_a_loop(spark):
    rng = np.random.default_rng(11)
    values = np.round(rng.exponential(5, 40), 1)
    centers = np.round(rng.normal(20, 5, 120), 1)
    truths = centers + rng.choice([-1, 1], 120) * rng.choice(values, 120)
    for alpha in (0.1, 0.3):
        assert trace(spark, values, centers, truths, alpha, gamma=0.05) == brute(values, centers, truths, alpha, 0.05)


def test_future_outcomes_do_not_change_earlier_intervals(spark):
    values, centers, truths = range(1, 11), [5.0] * 6, [5, 9, 30, 5, 5, 5]
    first = trace(spark, values, centers, truths, 0.2)
    other = trace(spark, values, centers, [*truths[:3], 99, 99, 99], 0.2)
    assert first[:3] == other[:3]
    # The fourth interval is fixed before its own outcome.
    assert (first[3][0], first[3][2]) == (other[3][0], other[3][2])


def test_covering_score_is_the_exact_threshold():
    rng = np.random.default_rng(4)
    c, y = rng.normal(size=500) * 100, rng.normal(size=500) * 100
    s = adaptive.smallest_covering_score(c, y)
    assert ((y >= c - s) & (y <= c + s)).all()
    below = np.nextafter(s, -np.inf)
    assert not (((y >= c - below) & (y <= c + below)) & (s > 0)).any()


def test_parameters_and_policy(spark):
    with pytest.raises(ContractError):
        trace(spark, (1, 2), [1], [1], 0.1, gamma=0.0)
    with pytest.raises(ContractError):
        trace(spark, (1, 2), [1], [1], 0.1, policy="other")
    with pytest.raises(Exception, match="unattainable"):
        trace(spark, (1, 2), [1], [1], 0.1, policy="raise")
    assert trace(spark, (1, 2), [1], [99], 0.1, policy="infinite")[0][2:] == (float("inf"), False)


def test_threshold_far_below_the_residual():
    """Around 100, values far below an ulp of it already cover its next double."""
    center, truth = np.array([100.0, 100.0, -3.0, 1e300, 0.0]), np.array([np.nextafter(100, 200), 100.0, 5.0, -1e300, 5e-324])
    s = adaptive.smallest_covering_score(center, truth)
    assert ((truth >= center - s) & (truth <= center + s)).all()
    below = np.nextafter(s, -np.inf)
    short = (below < 0) | (truth < center - below) | (truth > center + below)
    assert short.all() and s[1] == 0.0 and s[0] < 1e-14
