import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcal.operators import reservoir as res
from panelcal.schema import ContractError


def audit(spark, values, cells, evaluation=None, scale=125):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, entity_id int, score double")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("reservoir_size"))
    grid = res.cell_grid(res.declared_cells(spark, cells), sizes)
    dist = res.quantile_distribution(rows, grid, ["k"], slices=4)
    if evaluation is None:
        return grid, dist
    held = spark.createDataFrame([("a", float(v)) for v in evaluation], "k string, score double")
    return grid, dist, res.quantile_outcomes(dist, held, ["k"], scale=scale, slices=4)


def test_distribution_equals_enumeration(spark):
    values, n, alpha = range(1, 8), 4, 0.40
    rank = math.ceil((n + 1) * (1 - alpha))
    want = {}
    for subset in itertools.combinations(values, n):
        q = float(sorted(subset)[rank - 1])
        want[q] = want.get(q, 0) + 1
    _, dist = audit(spark, values, [("x", n, alpha)])
    got = {r.quantile: int(r.multiplicity) for r in dist.collect()}
    assert got == want and sum(got.values()) == 35


def test_only_identical_doubles_merge(spark):
    values = (1.0, 1.0, math.nextafter(1.0, 2.0), 2.0, 3.0)
    _, dist = audit(spark, values, [("x", 2, 0.5)])
    rows = {r.quantile: r for r in dist.collect()}
    assert set(rows) == {1.0, math.nextafter(1.0, 2.0), 2.0, 3.0}
    assert json.loads(rows[1.0].position_multiplicities) == {"2": 1}


def test_supports_and_exclusions(spark):
    cells = [("p", 10, 0.1), ("p", 15, 0.1), ("p", 20, 0.1), ("p", 30, 0.1), ("s", 20, 0.05), ("s", 30, 0.05), ("s", 10, 0.05), ("s", 40, 0.1)]
    grid, dist = audit(spark, range(40), cells)
    sizes = {(r.n_cal, r.alpha): r["count"] for r in dist.groupBy("n_cal", "alpha").count().collect()}
    assert sizes == {(10, 0.1): 31, (15, 0.1): 26, (20, 0.1): 21, (30, 0.1): 11, (20, 0.05): 21, (30, 0.05): 11}
    rows = {(r.n_cal, r.alpha): r for r in grid.collect()}
    assert rows[10, 0.05].status == "excluded_unattainable" and rows[40, 0.1].status == "excluded_degenerate"
    assert int(rows[10, 0.1].combination_count) == 847660528 and int(rows[20, 0.1].combination_count) == 137846528820
    assert rows[10, 0.1].finite_population_factor == pytest.approx(30 / 39)
    for r in dist.groupBy("cell_id").agg(F.sum("probability").alias("p")).collect():
        assert abs(r.p - 1) <= 1e-12


def test_exact_counts_beyond_the_digits_of_a_decimal(spark):
    _, dist = audit(spark, range(400), [("p", 100, 0.1)])
    rows = dist.collect()
    rank = math.ceil(101 * 0.9)
    for r in rows[::25]:
        k = r.position_min
        exact = math.comb(k - 1, rank - 1) * math.comb(400 - k, 100 - rank) / math.comb(400, 100)
        assert r.probability == pytest.approx(exact, rel=1e-15) and int(r.multiplicity) == math.comb(k - 1, rank - 1) * math.comb(400 - k, 100 - rank)
    assert abs(sum(r.probability for r in rows) - 1) <= 1e-12


def test_outcomes_by_brute_force(spark):
    held = np.array([0.5, 2.0, 2.0, 6.5, 9.0])
    _, _, out = audit(spark, range(1, 8), [("x", 4, 0.4)], held)
    for r in out.collect():
        q = r.quantile
        assert r.coverage == np.mean(held <= q)
        assert r.normalized_interval_score == pytest.approx(np.mean(2 * q + 2 / 0.4 * np.maximum(held - q, 0)) / 125)
        assert r.severe_undercoverage == (r.coverage < (1 - 0.4) - 0.1)


def test_beta_table(spark):
    grid, _ = audit(spark, range(40), [("p", n, a) for n, a in ((10, 0.1), (15, 0.1), (20, 0.1), (30, 0.1), (20, 0.05), (30, 0.05))])
    rows = {(r.n_cal, r.alpha): r for r in res.beta_reference(grid, ["k"]).collect()}
    mean = {(10, 0.1): 0.9091, (15, 0.1): 0.9375, (20, 0.1): 0.9048, (30, 0.1): 0.9032, (20, 0.05): 0.9524, (30, 0.05): 0.9677}
    tail = {(10, 0.1): 0.1074, (15, 0.1): 0.0352, (20, 0.1): 0.0692, (30, 0.1): 0.0442, (20, 0.05): 0.0388, (30, 0.05): 0.0076}
    for key, row in rows.items():
        assert round(row["mean"], 4) == mean[key]
        assert round(row.severe_probability, 4) == tail[key]
    # Beta(10, 1) has the closed quantile p ** (1 / 10).
    assert rows[10, 0.1].quantile_05 == pytest.approx(0.05 ** 0.1, abs=1e-12)


def test_beta_binomial_sums_to_one(spark):
    grid, _ = audit(spark, range(40), [("p", 20, 0.1)])
    rows = res.beta_binomial(grid, ["k"]).collect()
    assert len(rows) == 101 and abs(sum(r.probability for r in rows) - 1) < 1e-12
    a, b, x = 19, 2, 90
    lg = math.lgamma
    want = math.comb(100, x) * math.exp(lg(x + a) + lg(100 - x + b) - lg(100 + a + b) - lg(a) - lg(b) + lg(a + b))
    assert {r.covered_endpoints: r.probability for r in rows}[x] == pytest.approx(want, rel=1e-10)


def distribution(spark, pairs):
    return spark.createDataFrame([("a", float(v), float(p)) for v, p in pairs], "k string, value double, probability double")


def test_ks_and_wasserstein_literals(spark):
    two, point = distribution(spark, [(0.25, 0.5), (0.75, 0.5)]), distribution(spark, [(0.5, 1.0)])
    assert res.ks_discrete(two, point, ["k"]).first().ks_distance == 0.5
    left, right = distribution(spark, [(0.6, 0.5), (0.8, 0.5)]), distribution(spark, [(0.5, 0.5), (0.7, 0.5)])
    for _ in range(1):
        got = res.wasserstein_discrete(left, right, ["k"]).first().wasserstein_1
        assert got == pytest.approx(0.1, abs=1e-12)


def test_beta_distance_matches_integration(spark):
    params = spark.createDataFrame([("a", 1, 1)], "k string, a bigint, b bigint")
    got = res.beta_distances(distribution(spark, [(0.5, 1.0)]), params, ["k"]).first()
    assert got.wasserstein_1 == pytest.approx(0.25, abs=1e-12) and got.ks_distance == 0.5
    steps = [(0.7, 0.2), (0.85, 0.5), (0.95, 0.3)]
    params = spark.createDataFrame([("a", 19, 2)], "k string, a bigint, b bigint")
    got = res.beta_distances(distribution(spark, steps), params, ["k"]).first()
    x = (np.arange(400000) + 0.5) / 400000
    cdf = 20 * x**19 - 19 * x**20
    finite = sum(p * (x >= v) for v, p in steps)
    assert got.wasserstein_1 == pytest.approx(np.mean(np.abs(finite - cdf)), abs=1e-6)


def test_invalid_cells(spark):
    with pytest.raises(ContractError):
        res.declared_cells(spark, [("p", 0, 0.1)])
    with pytest.raises(ContractError):
        res.declared_cells(spark, [("p", 5, 1.0)])


def test_empirical_wasserstein(spark):
    left = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    right = spark.createDataFrame([(2.0,), (2.0,), (6.0,)], "v double")
    x, y = np.repeat([1.0, 3.0], 3), np.repeat([2.0, 2.0, 6.0], 2)
    got = res.empirical_wasserstein(left, right, [], "v").first().wasserstein_1
    assert got == pytest.approx(np.mean(np.abs(np.sort(x) - np.sort(y))))


def test_exact_multiplicities_of_a_large_reservoir(spark):
    """C(1000, 5) has 12 digits, C(1000, 400) has 291: both are exact, and so is each position's number."""
    import json
    from math import comb

    store = spark.createDataFrame([(i, float(i // 2)) for i in range(1000)], "entity_id long, score double")
    cells = res.declared_cells(spark, [("primary", 5, 0.4), ("primary", 400, 0.1)])
    sizes = spark.createDataFrame([(1000,)], "reservoir_size long")
    grid = res.cell_grid(cells, sizes)
    status = {r.n_cal: (r.combination_count, r.combination_status) for r in grid.collect()}
    assert int(status[5][0]) == comb(1000, 5) and status[5][1] == "exact" and status[400] == (str(comb(1000, 400)), "exact")
    found = res.quantile_distribution(store, grid, []).collect()
    small = {r["quantile"]: r for r in found if r.n_cal == 5}
    rank = 4
    for q, row in small.items():
        positions = [p for p in (2 * int(q) + 1, 2 * int(q) + 2) if rank <= p <= 1000 - 5 + rank]
        assert int(row.multiplicity) == sum(comb(p - 1, rank - 1) * comb(1000 - p, 5 - rank) for p in positions)
    assert sum(int(r.multiplicity) for r in small.values()) == comb(1000, 5)
    large = {r["quantile"]: r for r in found if r.n_cal == 400}
    rank = math.ceil(401 * 0.9)
    for q, row in large.items():
        want = {p: comb(p - 1, rank - 1) * comb(1000 - p, 400 - rank) for p in (2 * int(q) + 1, 2 * int(q) + 2) if rank <= p <= 600 + rank}
        assert int(row.multiplicity) == sum(want.values()) and {int(k): int(v) for k, v in json.loads(row.position_multiplicities).items()} == want
        assert row.probability == pytest.approx(sum(want.values()) / comb(1000, 400), rel=1e-14)
    assert sum(int(r.multiplicity) for r in large.values()) == comb(1000, 400)
    assert all(r.multiplicity is not None and r.combination_count is not None for r in found)


def test_counts_of_more_digits_than_are_held(spark, monkeypatch):
    """Beyond MAX_DIGITS the subset count says so, and probabilities come from logarithms."""
    sizes = spark.createDataFrame([(20_000,)], "reservoir_size long")
    grid = res.cell_grid(res.declared_cells(spark, [("p", 9_000, 0.1)]), sizes)
    row = grid.first()
    assert row.combination_count is None and row.combination_status == "beyond_digits"
    store = spark.range(20_000).select(F.col("id").alias("entity_id"), F.floor(F.col("id") / 500).cast("double").alias("score"))
    found = res.quantile_distribution(store, grid, []).collect()
    assert abs(sum(r.probability for r in found) - 1) < 1e-9 and all(r.multiplicity is None and r.position_multiplicities == "{}" for r in found)
