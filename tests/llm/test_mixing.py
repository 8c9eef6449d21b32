from collections import Counter

import pytest

from panelcal.llm.mixing import mix, schedule, shares, tempered_weights


def plain_schedule(sizes):
    """Earliest deadline first among released blocks, slot by slot."""
    total, served, out = sum(sizes), [0] * len(sizes), []
    for t in range(total):
        ready = [(-(-(k + 1) * total // s), i) for i, (k, s) in enumerate(zip(served, sizes)) if k * total // s <= t]
        out.append(min(ready)[1])
        served[out[-1]] += 1
    return out


def test_schedule_deviates_by_less_than_a_block(spark):
    for weights in ([7, 1, 1, 1], [5], [1] * 10, [400, 3, 250, 1, 90]):
        table = spark.createDataFrame([(f"s{i:02d}", w) for i, w in enumerate(weights)], "source string, weight long")
        shared = shares(table, 60).orderBy("idx").collect()
        sizes = [r.share for r in shared]
        assert sum(sizes) == 60 and min(sizes) >= 1
        got = [r.idx - 1 for r in schedule(shares(table, 60), 60).orderBy("slot").collect()]
        assert got == plain_schedule(sizes)
        served = [0] * len(sizes)
        for t, i in enumerate(got, 1):
            served[i] += 1
            assert all(abs(n - t * s / 60) < 1 for n, s in zip(served, sizes))


def test_whole_mix_with_a_hot_source_nulls_and_clashing_columns(spark):
    rows = [(i, "hot" if i < 500 else None if i < 540 else "rare" if i < 541 else "mid", i, "t") for i in range(700)] + [(3, "hot", 3, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot int, text string").repartition(5)
    got = mix(docs, tempered_weights(docs, 0.5), ["doc_id"], block_rows=8, resolution=100).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    first = Counter(r.doc_id for r in got if r.epoch == 0)
    assert first[3] == 2 and sum(first.values()) == len(rows)
    places = Counter((r.slot, r.place) for r in got)
    assert max(places.values()) == 1
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.slot, set()).add(r.source)
    assert all(len(v) == 1 for v in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    stop = mix(docs, tempered_weights(docs, 0.5), ["doc_id"], block_rows=8, resolution=100, until="first").collect()
    assert len(stop) < len(rows) and all(r.epoch == 0 for r in stop)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    weights = spark.createDataFrame([("a", 1), ("b", 0), ("c", 4)], "source string, weight long")
    assert {r.source for r in mix(docs, weights, ["doc_id"]).collect()} == {"a"}
    assert mix(docs.limit(0), tempered_weights(docs.limit(0), 0.7), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        shares(weights, 1).count()
    with pytest.raises(ValueError):
        mix(docs, weights, ["doc_id"], until="never")


def test_many_skewed_sources_each_have_slots(spark):
    from panelcal.llm.mixing import fitting_resolution

    for n in (900, 1500):
        weights = spark.createDataFrame([(f"s{i:04d}", int((10_000 * n / (i + 1)) ** 0.7)) for i in range(n)], "source string, weight long")
        for resolution in {max(1000, n), fitting_resolution(weights)}:
            got = [r.share for r in shares(weights, resolution).collect()]
            assert len(got) == n and sum(got) == resolution and min(got) >= 1
    # A third of the rows in one of 999 sources: its share stays near its weight.
    hot = spark.createDataFrame([(f"s{i:04d}", 499 if i == 0 else 1) for i in range(999)], "source string, weight long")
    resolution = fitting_resolution(hot)
    assert abs({r.source: r.share for r in shares(hot, resolution).collect()}["s0000"] / resolution - 1 / 3) < 0.01


def test_mix_of_900_skewed_sources_leaves_no_row_out(spark):
    rows = [(i, f"s{k:03d}") for i, k in enumerate(k for k in range(900) for _ in range(1 + 600 // (k + 1)))]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    got = mix(docs, tempered_weights(docs, 0.7), ["doc_id"], until="all").collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert Counter(r.doc_id for r in got if r.epoch == 0) == Counter(i for i, _ in rows)


def test_sql_gives_the_same_mix_for_skewed_sources(spark):
    """100 sources of which one has very many rows and half have one: the period is longer than that of few sources."""
    import duckdb

    from panelcal.llm.queries import OP7_SQL

    for sizes in ([6000] + [40] * 50 + [1] * 49, [50] * 30, [900, 3, 2]):
        rows = [(i, f"s{k:03d}") for i, k in enumerate(k for k, n in enumerate(sizes) for _ in range(n))]
        docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
        got = sorted((r.doc_id, r.source, r.epoch, r.slot, r.place) for r in mix(docs, tempered_weights(docs, 0.7), ["doc_id"]).collect())
        connection = duckdb.connect()
        connection.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR)")
        connection.execute("INSERT INTO documents SELECT unnest($1), unnest($2)", [[i for i, _ in rows], [s for _, s in rows]])
        assert got == sorted(connection.execute(OP7_SQL).fetchall())
