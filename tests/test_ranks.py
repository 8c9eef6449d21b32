import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcal.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key, and half of those share one value."""
    rng = np.random.default_rng(5)
    n = 6000
    group = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 20, n).astype(str))
    value = np.where((group == "hot") & (rng.random(n) < 0.5), 7.0, np.round(rng.normal(size=n), 2))
    pdf = pd.DataFrame({"g": group, "v": value, "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_order_statistics_are_exact(skewed):
    pdf, df = skewed
    shares = [0.001, 0.25, 0.5, 0.9, 0.999, 1.0]

    def wanted(sizes):
        return sizes.withColumn("p", F.explode(F.array(*[F.lit(p) for p in shares]))).withColumn(
            "rank", F.ceil(F.col("n") * F.col("p"))
        )

    for row in ranks.order_statistics(df, ["g"], "v", wanted).collect():
        expected = np.sort(pdf.v[pdf.g == row.g].to_numpy())[row["rank"] - 1]
        assert row.v == expected, row


def test_order_statistics_with_tie_columns_and_invalid_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0)], "id int, v double")
    got = ranks.order_statistics(
        df, [], "v", lambda s: s.withColumn("rank", F.explode(F.array(F.lit(2), F.lit(3), F.lit(9)))), tie=["id"]
    ).collect()
    assert {(r["rank"], r.v, r.id) for r in got if r["rank"] in (2, 3) and r.v is not None} >= {(2, 5.0, 1), (3, 5.0, 2)}


@pytest.mark.parametrize("slices", [2, 16, 256])
@pytest.mark.parametrize("parts", [1, 5])
def test_running_totals_match_a_sorted_sum(skewed, slices, parts):
    pdf, df = skewed
    rows = df.repartition(parts).withColumn("w", F.lit(1))
    got = ranks.running_totals(rows, ["g"], "v", {"w": "upto"}, slices=slices, following="after").toPandas()
    for g, part in pdf.groupby("g"):
        mine = got[got.g == g].sort_values("v")
        counts = part.v.value_counts().sort_index()
        assert mine.v.tolist() == counts.index.tolist()
        assert mine.upto.tolist() == counts.cumsum().tolist()
        assert mine.after.iloc[:-1].tolist() == counts.index[1:].tolist()
        assert pd.isna(mine.after.iloc[-1])


def test_distributed_rank_has_no_gaps_and_keeps_order(skewed):
    pdf, df = skewed
    got = ranks.distributed_rank(df, [], "v", ["id"], slices=32).toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(1, len(pdf) + 1))
    assert (got.v.diff().dropna() >= 0).all()
    again = ranks.distributed_rank(df.repartition(3), [], "v", ["id"], slices=8).toPandas().set_index("id")["rank"]
    assert (got.set_index("id")["rank"].sort_index() == again.sort_index()).all()


def test_grouped_position_equals_row_number(skewed):
    pdf, df = skewed
    got = ranks.grouped_position(df, ["g"], ["id"], F.floor(F.col("id") / 100)).toPandas()
    want = pdf.assign(position=pdf.groupby("g").cumcount() + 1)
    assert got.set_index("id").position.sort_index().tolist() == want.set_index("id").position.tolist()


def test_as_of_lookup_both_ways(spark):
    steps = [("a", 1.0, 10.0), ("a", 2.5, 20.0), ("a", 7.0, 30.0), ("b", 4.0, 40.0)]
    thresholds = [("a", 0.5), ("a", 1.0), ("a", 2.6), ("a", 7.0), ("a", 8.0), ("b", 4.0), ("b", 4.1)]
    s = spark.createDataFrame(steps, "g string, c double, p double")
    t = spark.createDataFrame(thresholds, "g string, t double")
    want = {(g, x): min([p for h, c, p in steps if h == g and c >= x], default=None) for g, x in thresholds}
    for lookup in (ranks.first_at_or_above, ranks.attach_first_at_or_above_bounded):
        got = {(r.g, r.t): r.p for r in lookup(t, s, ["g"], "t", "c", "p").collect()}
        assert got == want


def test_counts_up_to_points(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    points = spark.createDataFrame([(0.0,), (2.0,), (9.0,)], "v double")
    got = {r.v: (r.rows_upto, r.sum_upto) for r in ranks.count_and_sum_up_to(points, rows, [], "v", slices=2).collect()}
    assert got == {0.0: (0, 0.0), 2.0: (3, 5.0), 9.0: (4, 10.0)}
    strict = {r.v: r.rows_upto for r in ranks.count_and_sum_up_to(points, rows, [], "v", strict=True, slices=2).collect()}
    assert strict == {0.0: 0, 2.0: 1, 9.0: 4}


def test_rank_plan_has_no_window_over_all_rows(skewed):
    _, df = skewed
    plan = ranks.distributed_rank(df, [], "v", ["id"], slices=32)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number" in line]
    assert windows and all("_h" in line for line in windows)


def test_a_value_of_nearly_all_rows_is_spread_over_tasks(spark):
    """Broadcasts and re-planning off: no task of the last stage holds the rows of the hot value."""
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select(F.col("id"), F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("v"))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}.items():
            spark.conf.set(k, v)
        ranked = ranks.distributed_rank(rows, [], "v", ["id"])
        sizes = [r[1] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 40_000 / 4
        got = [r[0] for r in ranked.select("rank").orderBy("rank").collect()]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert got == list(range(1, 40_001))


def test_a_group_of_nearly_all_rows_is_spread_over_tasks(spark):
    """Broadcasts and re-planning off: the running totals of a group of 99% of all distinct values lie in many tasks."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("g"), F.col("id").alias("v"), F.lit(1).cast("bigint").alias("w"))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}.items():
            spark.conf.set(k, v)
        found = ranks.running_totals(rows, ["g"], "v", {"w": "upto"}, following="after")
        sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 40_000 / 3
        plan = found._jdf.queryExecution().executedPlan().toString()
        hot = found.where("g = 7").orderBy("v").collect()
        untied = ranks.distributed_rank(rows.select("g"), [], "g", [])
        assert max(r[1] for r in untied.groupBy(F.spark_partition_id()).count().collect()) < 40_000 / 3
        assert sorted(r[0] for r in untied.select("rank").collect()) == list(range(1, 40_001))
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert [r.upto for r in hot] == list(range(1, len(hot) + 1)) and [r.after for r in hot] == [r.v for r in hot[1:]] + [None]
    # What is exchanged on the group alone is one row a part: its sums.
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning(g#" in line and "_part" not in line.split("hashpartitioning(")[1].split(")")[0]]
    assert len(exchanged) == 1


def test_null_groups_and_values_keep_their_place(spark):
    rows = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 1), ("a", 1.0, 1), ("a", None, 1)], "g string, v double, w long")
    got = {(r.g, r.v): r.upto for r in ranks.running_totals(rows, ["g"], "v", {"w": "upto"}).collect()}
    assert got == {(None, 1.0): 1, (None, 2.0): 2, ("a", None): 1, ("a", 1.0): 2}
    assert ranks.running_totals(rows.limit(0), ["g"], "v", {"w": "upto"}).count() == 0
    assert ranks.distributed_rank(rows.limit(0), ["g"], "v", []).count() == 0
