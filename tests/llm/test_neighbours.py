import numpy as np

from panelcal.llm.neighbours import nearest


def exact(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)
        out[q] = scored[:k]
    return out


def test_recall_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    vectors = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=24) * (0.1 if i % 3 else 1.5)]) for i in range(900)]
    hot = vectors[0][1]
    vectors += [(i, hot) for i in range(900, 1200)]
    bad = [(5000, None), (5001, [0.0] * 24), (5002, [None] + [1.0] * 23), (5003, [float("nan")] + [1.0] * 23), (5004, [float("inf")] + [1.0] * 23), (5020, [1.0, 2.0]), (None, hot), (900, hot)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in vectors + bad], "vec_id long, embedding array<float>, score double").repartition(5)
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    queries = [(i, v) for i, v in vectors if i % 20 == 0]
    want = exact(vectors, queries, 20)
    assert set(got) == set(want)
    hits = 0
    by = dict(vectors)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        for _, i, s in found:
            assert abs(s - np.dot(by[q], by[i])) < 1e-9 and i != q
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    assert [i for _, i, _ in got[900]] == [i for _, i in want[900]]


def test_fewer_vectors_than_asked_for_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, df.where("vec_id = 0"), k=20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0
    assert nearest(df, df.limit(0)).count() == 0
