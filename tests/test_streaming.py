import numpy as np
from pyspark.sql import functions as F

from panelcal.operators.adaptive import adaptive_trace
from panelcal.operators.features import temporal_features
from panelcal.session import configure, scratch_path
from panelcal.streaming import adaptive as streaming
from panelcal.streaming import features, lookup
from panelcal.streaming.features import window_values
from panelcal.streaming.lookup import index_scores
from panelcal.streaming.ordered import finish, with_flush

SCHEMA = "model string, alpha double, ts timestamp, seq bigint, center double, truth double"


def replay(spark, rows, files=6):
    path = scratch_path(spark, "t-in")
    rows.repartition(files, F.xxhash64("seq", "center")).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def data(spark, n=30):
    rng = np.random.default_rng(3)
    scores = spark.createDataFrame([("m", float(v)) for v in np.round(rng.exponential(5, 25), 1)], "model string, score double")
    rows = spark.createDataFrame(
        [("m", 0.2, i, float(c), float(c + e)) for i, (c, e) in enumerate(zip(rng.normal(50, 5, n), rng.normal(0, 8, n), strict=True))],
        "model string, alpha double, seq bigint, center double, truth double",
    ).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1000))
    return scores, rows.select("model", "alpha", "ts", "seq", "center", "truth")


def test_stream_equals_batch_when_files_arrive_out_of_order(spark):
    scores, rows = data(spark)
    stream = replay(spark, with_flush(rows, {"model": "flush", "alpha": 0.5, "seq": 0}, 3600))
    out = streaming.adaptive_stream(stream, index_scores(scores, ["model"]), ["model", "alpha"], delay="60 seconds")
    got = finish(out, scratch_path(spark, "t-out"), scratch_path(spark, "t-cp")).filter("model = 'm'")
    batch = adaptive_trace(
        rows.drop("alpha").withColumnsRenamed({"center": "pred", "truth": "y_true"}), scores, ["model"], ["model"], [0.2], slices=8
    )
    columns = ["seq", "alpha_used", "alpha_next", "quantile", "lower", "upper", "requested_rank", "miss"]
    assert sorted(got.select(*columns).collect()) == sorted(batch.select(*columns).collect())
    assert got.filter("status <> 'ok'").count() == 0


def test_outcome_rules(spark):
    scores, _ = data(spark)
    events = [(0, 0, 10, 50.0, None), (0, 1, 11, 51.0, None), (1, 7, 12, None, 1.0), (1, 0, 13, None, 50.0), (1, 1, 14, None, 51.0)]
    rows = spark.createDataFrame(
        [("m", 0.2, kind, seq, t, c, y) for kind, seq, t, c, y in events],
        "model string, alpha double, kind int, seq bigint, t bigint, center double, truth double",
    ).select("model", "alpha", F.timestamp_seconds("t").alias("ts"), "seq", "kind", "center", "truth")
    stream = replay(spark, with_flush(rows, {"model": "flush", "alpha": 0.5, "seq": 0, "kind": 1}, 3600), 2)
    out = streaming.adaptive_stream(stream, index_scores(scores, ["model"]), ["model", "alpha"], delay="60 seconds", separate_outcomes=True)
    got = finish(out, scratch_path(spark, "t-out"), scratch_path(spark, "t-cp")).filter("model = 'm'").collect()
    kinds = sorted((r.seq, r.status, r.miss is not None) for r in got)
    assert kinds == [
        (0, "ok", False),
        (0, "ok", True),
        (1, "held", False),
        (1, "ok", True),
        (7, "outcome_without_prediction", False),
    ]


def test_pages_answer_counts_and_ranks_at_any_depth(spark, monkeypatch):
    rng = np.random.default_rng(6)
    held = {"a": np.round(rng.exponential(5, 700), 2), "b": np.array([3.0]), "c": np.full(300, 7.0), "d": np.arange(40.0)}
    scores = spark.createDataFrame([(c, float(v)) for c, vs in held.items() for v in vs] + [("a", None)], "cell string, score double")
    asked = [(c, float(v)) for c in (*held, "none") for v in [-1.0, 0.0, 3.0, 7.0, 1e9, *rng.choice(held["a"], 15), *rng.exponential(5, 15)]]
    ranks = [(c, int(k)) for c in (*held, "none") for k in [0, 1, 2, 40, 41, 299, 300, 301, 700, 701]] + [("a", None)]
    for page in (4, 1024):
        monkeypatch.setattr(lookup, "PAGE", page)
        index = index_scores(scores, ["cell"])
        assert len(index.levels) == (5 if page == 4 else 1)
        for level in index.levels:
            assert level.selectExpr("max(size(v))").first()[0] <= page
        points = spark.createDataFrame(asked, "cell string, x double")
        for r in index.with_counts(points, F.col("x")).collect():
            all_ = held.get(r.cell, np.zeros(0))
            assert (r.below, r.n) == ((all_ < r.x).sum(), len(all_))
        for r in index.with_score_at(spark.createDataFrame(ranks, "cell string, k bigint"), "k", "s").collect():
            all_ = np.sort(held.get(r.cell, np.zeros(0)))
            assert r.s == (all_[r.k - 1] if r.k and 1 <= r.k <= len(all_) else None)


def test_no_scores_at_all(spark):
    index = index_scores(spark.createDataFrame([], "cell string, score double"), ["cell"])
    assert [tuple(r) for r in index.with_counts(spark.createDataFrame([("a", 1.0)], "cell string, x double"), F.col("x")).collect()] == [("a", 1.0, 0, 0)]


def ordered_files(spark, parts):
    """One file a batch, in the given order."""
    path = scratch_path(spark, "t-in")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_rows_behind_the_watermark_come_out_late_and_change_nothing(spark):
    scores, rows = data(spark)
    flush = with_flush(rows, {"model": "flush", "alpha": 0.5, "seq": 0}, 3600).filter("model = 'flush'")
    behind = F.col("seq").isin(4, 11, 29)
    only_late = rows.filter("seq = 7").withColumn("model", F.lit("idle"))
    stream = ordered_files(spark, [rows.filter(~behind), flush, flush, rows.filter(behind).unionByName(only_late), flush])
    out = streaming.adaptive_stream(stream, index_scores(scores, ["model"]), ["model", "alpha"], delay="10 seconds")
    got = finish(out, scratch_path(spark, "t-out"), scratch_path(spark, "t-cp")).filter("model != 'flush'")
    batch = adaptive_trace(
        rows.filter(~behind).drop("alpha").withColumnsRenamed({"center": "pred", "truth": "y_true"}), scores, ["model"], ["model"], [0.2], slices=8
    )
    columns = ["seq", "alpha_used", "alpha_next", "quantile", "lower", "upper", "requested_rank", "miss"]
    assert sorted(got.filter("status = 'ok' and model = 'm'").select(*columns).collect()) == sorted(batch.select(*columns).collect())
    late = got.filter("status = 'late'").collect()
    assert sorted(r.seq for r in late) == [4, 11, 29]
    assert all(r.quantile is None and r.alpha_used is None and r.miss is None and r.center is not None for r in late)
    # A key that has answered nothing yet is not behind anything.
    assert [(r.seq, r.status) for r in got.filter("model = 'idle'").collect()] == [(7, "ok")]


def test_late_outcomes_and_a_long_queue(spark):
    scores, _ = data(spark)
    events = [(0, s, 10 + s, 50.0 + s, None) for s in range(40)] + [(1, s, 100 + s, None, 50.0 + s) for s in range(40)]
    schema = "model string, alpha double, kind int, seq bigint, t bigint, center double, truth double"
    rows = spark.createDataFrame([("m", 0.2, *e) for e in events], schema)
    rows = rows.select("model", "alpha", F.timestamp_seconds("t").alias("ts"), "seq", "kind", "center", "truth")
    flush = with_flush(rows, {"model": "flush", "alpha": 0.5, "seq": 0, "kind": 1}, 3600).filter("model = 'flush'")
    behind = (F.col("kind") == 1) & (F.col("seq") == 39)
    stream = ordered_files(spark, [rows.filter(~behind), flush, flush, flush, rows.filter(behind), flush, flush])
    out = streaming.adaptive_stream(stream, index_scores(scores, ["model"]), ["model", "alpha"], delay="10 seconds", separate_outcomes=True)
    got = finish(out, scratch_path(spark, "t-out"), scratch_path(spark, "t-cp")).filter("model = 'm'").collect()
    kinds = sorted((r.seq, r.status, r.miss is not None) for r in got)
    assert kinds == sorted([(0, "ok", False)] + [(s, "held", False) for s in range(1, 40)] + [(s, "ok", True) for s in range(39)] + [(39, "late", False)])
    first = next(r for r in got if r.seq == 0 and r.miss is None)
    values = sorted(r.score for r in scores.collect())
    assert first.quantile == values[first.effective_rank - 1] and first.lower == first.center - first.quantile


def test_windows_of_a_run_equal_those_row_by_row():
    rng = np.random.default_rng(2)
    for n, new in ((1, 1), (3, 3), (30, 30), (30, 4), (19, 19)):
        history = rng.normal(size=(n, 2)) * 3
        got = np.stack(window_values(history, new, (5, 10, 20)))
        for i in range(n - new, n):
            for s in range(2):
                want = [history[i, s] - history[i - 1, s] if i else 0.0]
                for w in (5, 10, 20):
                    part = history[max(0, i - w + 1) : i + 1, s]
                    slope = np.polyfit(np.arange(len(part)), part, 1)[0] if len(part) > 1 else 0.0
                    want += [part.mean(), part.std(), slope]
                assert np.allclose(got[:, i - (n - new), s], want, atol=1e-9)


def test_entities_share_keys_of_state_and_equal_the_batch(spark, monkeypatch):
    """A key of state for every entity made the calls and frames of each key the cost of a stream of many short entities."""
    monkeypatch.setattr(features, "KEYS", 8)
    rng = np.random.default_rng(5)
    cells = [(e, c, 1.0, float(rng.normal()), None if (e + c) % 9 == 0 else float(c % 4)) for e in range(1, 41) for c in range(1 if e % 2 else 15, 31)]
    panel = spark.createDataFrame(cells, "entity_id long, cycle long, op_setting_1 double, sensor_1 double, sensor_2 double")
    sensors, settings = ["sensor_1", "sensor_2"], ["op_setting_1"]
    rows = panel.select("entity_id", F.timestamp_seconds("cycle").alias("ts"), F.col("cycle").alias("seq"), *settings, *sensors)
    flush = with_flush(rows, {"entity_id": -1, "seq": 0}, 3600).filter("entity_id < 0")
    behind = (F.col("entity_id") == 3) & (F.col("seq") == 5)
    first = rows.filter("entity_id = 1 and seq = 7").withColumn("entity_id", F.lit(99).cast("long"))
    parts = [rows.filter(~behind & (F.col("seq") > low) & (F.col("seq") <= low + 10)) for low in (0, 10, 20)]
    stream = ordered_files(spark, [*parts, flush, flush, rows.filter(behind).unionByName(first), flush])
    checkpoint = scratch_path(spark, "t-cp")
    out = features.feature_stream(stream, sensors, settings=settings, delay="2 seconds")
    got = finish(out, scratch_path(spark, "t-out"), checkpoint).filter("entity_id > 0").collect()
    want = temporal_features(panel.filter(~((F.col("entity_id") == 3) & (F.col("cycle") == 5))), sensors, settings=settings).collect()
    found = {(r.entity_id, r.cycle): r for r in got}
    assert len(found) == len(got) == len(want) + 2
    assert found[3, 5].status == "late" and found[3, 5].sensor_1_delta_1 is None
    assert (found[99, 7].status, found[99, 7].sensor_1_rolling_mean_20) == ("ok", found[99, 7].sensor_1)
    for r in want:
        twin = found[r.entity_id, r.cycle]
        assert twin.status == "ok"
        np.testing.assert_allclose(*[np.array([x[n] for n in r.__fields__], float) for x in (twin, r)], atol=1e-9)
    kept = spark.read.format("statestore").option("stateVarName", "recent").load(checkpoint)
    assert kept.count() <= 9


def test_wide_stages_are_not_left_to_the_interpreter(spark):
    """Rounding 27 columns was slowed by one method of more than the 8,000 bytes that the JVM compiles."""
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
