import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcal.llm.whitening import leading, whiten

BAD = [(900, None), (901, [None] + [0.5] * 11), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [1.0, 2.0]), (905, []), (906, [1e300] + [0.0] * 11)]


def table(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    return made.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["x", "v", "id", "n", "component", "whitened", "at", "value"])])


def vectors(n, d, seed=4):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, d)) * np.linspace(1.0, 0.2, d) + rng.normal(size=d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(v)]


def exact(rows, k):
    """n, deviations, whitened rows and shares by a full eigendecomposition."""
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1)
    c = x - s / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return deviation, c @ u / np.sqrt(e), e / np.trace(cov)


def test_components_equal_a_full_decomposition(spark):
    rows = vectors(700, 12)
    rows += [(i, rows[3][1]) for i in range(2000, 2300)] + [(3, rows[3][1]), (None, rows[5][1])]
    deviation, white, share = exact(rows, 8)
    want = {}
    for (i, _), s, w in zip(rows, deviation, white):
        want.setdefault((i, int(s)), []).append(w)
    got = whiten(table(spark, rows + BAD)).collect()
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for r in got:
        w = want[r.vec_id, r.deviation][0][r.component - 1]
        signs.setdefault(r.component, np.sign(w) * np.sign(r.whitened))
        assert abs(r.whitened * signs[r.component] - w) < 1e-8 and abs(r.explained / share[r.component - 1] - 1) < 1e-9
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i, _ in rows for c in range(1, 9)}


def test_few_dimensions_and_rows(spark):
    rows = vectors(50, 3)
    got = whiten(table(spark, rows)).collect()
    deviation, white, share = exact(rows, 3)
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 150
    assert {(r.vec_id, r.deviation) for r in got} == {(i, int(s)) for (i, _), s in zip(rows, deviation)}
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-9
    # Three different vectors span two dimensions; equal vectors none.
    got = whiten(table(spark, vectors(3, 12))).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9
    assert whiten(table(spark, [(i, [0.5, 0.25]) for i in range(9)])).count() == 0
    assert whiten(table(spark, vectors(1, 4))).count() == 0
    assert whiten(table(spark, BAD[:4] + BAD[5:])).count() == 0
    assert whiten(table(spark, rows).limit(0)).count() == 0


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float(i % 2) * 2.0**40, 1.0]) for i in range(6)]
    got = whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1} and {r.deviation for r in got} == {None}
    rows = [(i, [float(i % 2) * 2.0**19, 1.0]) for i in range(6)]
    assert {r.deviation for r in whiten(table(spark, rows)).collect()} == {(3 << 29) ** 2}


@pytest.mark.parametrize("spectrum", [np.ones(80), np.repeat([5.0, 1.0], 40), 1 + 1e-4 * np.arange(80), 0.8 ** np.arange(80), np.r_[np.ones(9), np.zeros(71)]])
def test_hard_spectra_are_certified(spectrum):
    rng = np.random.default_rng(1)
    u = np.linalg.qr(rng.normal(size=(80, 80)))[0]
    v = (u * spectrum) @ u.T
    values, found, residual = leading(lambda q: v @ q, 80, 8)
    assert residual <= 1e-11 and np.abs(values - np.sort(spectrum)[::-1][:8]).max() < 1e-11
    assert np.abs(found.T @ found - np.eye(8)).max() < 1e-12 and np.abs(v @ found - found * values).max() < 1e-10
