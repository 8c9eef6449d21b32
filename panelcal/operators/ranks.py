"""Exact order statistics, running totals, ranks and as-of lookups without a one-task sort.

A window without a bounded partition key puts a whole group into one task. These operators
keep every window bounded:

* ``order_statistics`` brackets each wanted rank with a quantile sketch, whose rank error is
  guaranteed, counts what lies outside the bracket with a partial aggregate and sorts only
  the few rows inside it. The result is exact; nothing but candidates is shuffled.
* ``running_totals`` is a parallel prefix scan: equal values merge, range partitions hold the
  values in order, their sums give each partition of a group its offset, and a window runs
  inside a partition. ``distributed_rank`` does the same for rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcal.session import stored

GRID = 1000
ACCURACY = 10000


def _sketch(value: str, steps: range, whole: int, accuracy: int) -> Column:
    """Approximate quantiles at k / whole. The list is one foldable text: a thousand literal
    nodes would be analysed again with every later transformation of the plan."""
    listed = ",".join(repr(k / whole) for k in steps)
    return F.expr(f"percentile_approx(`{value}`, cast(split('{listed}', ',') as array<double>), {accuracy})")


def order_statistics(
    rows: DataFrame,
    by: Sequence[str],
    value: str,
    wanted: Callable[[DataFrame], DataFrame],
    *,
    tie: Sequence[str] = (),
    bounded_cells: bool = False,
    all_valid: bool = False,
) -> DataFrame:
    """Value at exact ranks per group.

    ``wanted`` receives one row per group with its size ``n`` and returns the requests: the
    same columns, further key columns and ``rank`` (1-based; rows with a null rank or a rank
    outside 1..n are returned with a null value). ``tie`` columns order equal values and are
    returned too. ``bounded_cells`` says that ``by`` counts a declared grid, not data, so the
    requests may be broadcast; otherwise Spark picks the join. ``all_valid`` says that every
    rank lies in 1..n, which saves the join that restores the others.
    """
    by = list(by)
    sizes = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), _sketch(value, range(GRID + 1), GRID, ACCURACY).alias("_pivots")
    )
    requests = wanted(sizes)
    keys = [c for c in requests.columns if c not in ("_pivots", "rank")]
    valid = requests.filter((F.col("rank") >= 1) & (F.col("rank") <= F.col("n")))
    # The sketch returns values whose rank is off by at most n / ACCURACY, and neighbouring
    # grid points are n / GRID apart, so two grid points of slack always enclose the rank.
    low_at = (F.floor((F.col("rank") - 1) * GRID / F.col("n")) - 2).cast("int")
    high_at = (F.ceil(F.col("rank") * GRID / F.col("n")) + 2).cast("int")
    bracket = valid.select(
        *keys,
        "rank",
        F.when(low_at >= 0, F.expr(f"try_element_at(_pivots, cast(floor((rank - 1) * {GRID} / n) - 1 as int))")).alias("_low"),
        F.when(high_at <= GRID, F.expr(f"try_element_at(_pivots, cast(ceil(rank * {GRID} / n) + 3 as int))")).alias("_high"),
    )
    if bounded_cells:
        bracket = F.broadcast(bracket)
    v = F.col(value)
    zone = (
        F.when(F.col("_low").isNotNull() & (v < F.col("_low")), -1)
        .when(F.col("_high").isNotNull() & (v > F.col("_high")), 1)
        .otherwise(0)
    )
    joined = rows.select(*by, value, *tie).join(bracket, by) if by else rows.select(value, *tie).crossJoin(bracket)
    inside = F.col("_zone") == 0
    counted = (
        joined.withColumn("_zone", zone)
        .groupBy(
            *keys,
            "rank",
            "_zone",
            F.when(inside, v).alias("_v"),
            *[F.when(inside, F.col(t)).alias(f"_t_{t}") for t in tie],
        )
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    w = Window.partitionBy(*keys, "rank").orderBy("_zone", "_v", *[f"_t_{t}" for t in tie])
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    picked = (
        counted.withColumn("_upto", upto)
        .filter((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_c") < F.col("rank")))
        .select(
            *keys,
            "rank",
            F.when(inside, F.col("_v")).otherwise(F.raise_error(F.lit("rank outside its bracket"))).alias(value),
            *[F.col(f"_t_{t}").alias(t) for t in tie],
        )
    )
    if all_valid:
        return picked
    join_keys = [k for k in keys if k != "n"]
    found = picked.select(*join_keys, value, *tie)
    left = requests.drop("_pivots")
    return left.join(found, join_keys, "left") if join_keys else left.crossJoin(found)


def _in_ranges(rows: DataFrame, order: Sequence[str], slices: int | None) -> DataFrame:
    """The rows stored in range partitions of ``order``, with the number of each in ``_part``.

    Stored, as every branch of a plan must see the same cuts. Spark sizes the partitions; ``slices`` sets their number.
    """
    ranged = rows.repartitionByRange(slices, *order) if slices else rows.repartitionByRange(*order)
    return stored(ranged.withColumn("_part", F.spark_partition_id()), "ranges")


def _with_offsets(placed: DataFrame, by: list[str], sums: dict[str, Column], first: Column | None = None) -> DataFrame:
    """``placed`` with what each sum comes to in the earlier parts of its group, under the names of ``sums``.

    A group has one row a part here, however many rows it has. ``first``, the least value of a part, gives ``_next_first``, that of the
    group's next part.
    """
    found = placed.groupBy(*by, "_part").agg(*[c.alias(name) for name, c in sums.items()], *([first.alias("_first")] if first is not None else []))
    along = Window.partitionBy(*by).orderBy("_part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.lead("_first").over(along).alias("_next_first")] if first is not None else []
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_part"])]
    offsets = found.select(*keys, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums], *ahead)
    same = F.lit(True)
    for i, c in enumerate([*by, "_part"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(offsets, same).drop(*[f"_k{i}" for i in range(len(by) + 1)])


def running_totals(
    rows: DataFrame,
    by: Sequence[str],
    value: str,
    totals: dict[str, str],
    *,
    slices: int | None = None,
    following: str | None = None,
) -> DataFrame:
    """Inclusive running sums per group in value order, one row per distinct value.

    ``totals`` maps an input column to its running column. Returns ``by``, ``value``, the
    per-value sums under their input names, and the running columns. A parallel prefix scan: the merged values lie in
    range partitions, whose sums give each its offset, so a group of nearly all rows is spread like any other.
    ``following`` names an extra column with the next distinct value of the group.
    """
    by = list(by)
    merged = rows.groupBy(*by, value).agg(*[F.sum(c).alias(c) for c in totals])
    placed = _in_ranges(merged, [*by, value], slices)
    found = _with_offsets(placed, by, {f"_o_{c}": F.sum(c) for c in totals}, F.min(value) if following else None)
    ordered = Window.partitionBy(*by, "_part").orderBy(value)
    within = ordered.rowsBetween(Window.unboundedPreceding, 0)
    extra = [F.coalesce(F.lead(value).over(ordered), F.col("_next_first")).alias(following)] if following else []
    return found.select(
        *by,
        value,
        *totals,
        *[(F.col(f"_o_{c}") + F.sum(c).over(within)).alias(out) for c, out in totals.items()],
        *extra,
    )


def value_positions(rows: DataFrame, by: Sequence[str], value: str, *, slices: int | None = None) -> DataFrame:
    """First and last 1-based position of each distinct value in its sorted group."""
    found = running_totals(
        rows.select(*by, value, F.lit(1).cast("bigint").alias("ties")), by, value, {"ties": "position_max"}, slices=slices
    )
    return found.select(
        *by, value, "ties", (F.col("position_max") - F.col("ties") + 1).alias("position_min"), "position_max"
    )


def distributed_rank(
    rows: DataFrame,
    by: Sequence[str],
    value: str,
    tie: Sequence[str],
    *,
    out: str = "rank",
    slices: int | None = None,
) -> DataFrame:
    """1-based rank of every row, gap free, without a one-task sort.

    Equal values are ordered by the hash of ``tie`` and then by ``tie`` itself, without tie columns in any order; the rows are
    cut into ranges of value and hash, so a value held by a third of all rows is still spread over many tasks.
    """
    by = list(by)
    keyed = rows.withColumn("_h", F.xxhash64(*tie) if tie else F.monotonically_increasing_id())
    placed = _in_ranges(keyed, [*by, value, "_h"], slices)
    inner = Window.partitionBy(*by, "_part").orderBy(value, "_h", *tie)
    ranked = _with_offsets(placed, by, {"_before": F.count(F.lit(1))}).withColumn(out, F.col("_before") + F.row_number().over(inner))
    return ranked.drop("_h", "_part", "_before")


def grouped_position(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], part: Column, *, out: str = "position"
) -> DataFrame:
    """1-based row number per group in two levels.

    ``part`` must not decrease along ``order`` (a day of a timestamp, say). The window then
    sees one (group, part) at a time, and a long group adds only its number of parts.
    """
    by = list(by)
    keyed = rows.withColumn("_part", part)
    sizes = keyed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*by, "_part").orderBy(*order)
    return (
        keyed.withColumn("_rn", F.row_number().over(inner))
        .join(offsets, [*by, "_part"])
        .withColumn(out, F.col("_before") + F.col("_rn"))
        .drop("_part", "_rn", "_before")
    )


def count_and_sum_up_to(
    points: DataFrame, rows: DataFrame, by: Sequence[str], value: str, *, strict: bool = False, slices: int | None = None
) -> DataFrame:
    """For each distinct (by, value) point: how many rows have ``value <= point`` and their sum.

    The theta join as one running total over the union of both sides. ``strict`` counts
    ``value < point``. Points of a group without rows get 0. Adds ``rows_upto``, ``sum_upto``.
    """
    by = list(by)
    marks = points.select(*by, value).distinct().select(
        *by, value, F.lit(0).cast("bigint").alias("_n"), F.lit(0.0).alias("_x"), F.lit(1).cast("bigint").alias("_mark")
    )
    data = rows.select(
        *by,
        value,
        F.lit(1).cast("bigint").alias("_n"),
        F.col(value).cast("double").alias("_x"),
        F.lit(0).cast("bigint").alias("_mark"),
    )
    summed = running_totals(
        data.unionByName(marks), by, value, {"_n": "rows_upto", "_x": "sum_upto", "_mark": "_marks"}, slices=slices
    )
    less = F.col("_n") if strict else F.lit(0)
    less_sum = F.col("_x") if strict else F.lit(0.0)
    return summed.filter(F.col("_mark") > 0).select(
        *by, value, (F.col("rows_upto") - less).alias("rows_upto"), (F.col("sum_upto") - less_sum).alias("sum_upto")
    )


def first_at_or_above(
    thresholds: DataFrame,
    steps: DataFrame,
    by: Sequence[str],
    threshold: str,
    cumulative: str,
    payload: str,
    *,
    slices: int | None = None,
) -> DataFrame:
    """As-of join: for each threshold row the payload of the first step with cumulative >= threshold.

    ``cumulative`` must be increasing within a group. A threshold above the last step gets a
    null payload. The position of the wanted step is 1 + the number of steps strictly below
    the threshold, so a running count and one equi-join on that position answer it.
    """
    by = list(by)
    # A weight too small to move the sum leaves two steps equal; the first of them answers.
    steps = steps.groupBy(*by, cumulative).agg(F.min(payload).alias(payload))
    below = count_and_sum_up_to(
        thresholds.select(*by, F.col(threshold).alias("_v")),
        steps.select(*by, F.col(cumulative).alias("_v")),
        by,
        "_v",
        strict=True,
        slices=slices,
    ).select(*by, F.col("_v").alias(threshold), (F.col("rows_upto") + 1).alias("_at"))
    numbered = value_positions(steps.withColumn("_v", F.col(cumulative)), by, "_v", slices=slices).select(
        *by, F.col("_v").alias(cumulative), F.col("position_min").alias("_at")
    )
    placed = steps.select(*by, cumulative, payload).join(numbered, [*by, cumulative]).select(*by, "_at", payload)
    return thresholds.join(below, [*by, threshold], "left").join(placed, [*by, "_at"], "left").drop("_at")


def attach_first_at_or_above_bounded(
    thresholds: DataFrame,
    steps: DataFrame,
    by: Sequence[str],
    threshold: str,
    cumulative: str,
    payload: str,
) -> DataFrame:
    """The same lookup when the steps between the lowest and highest threshold are provably few.

    Only steps from the one before the lowest threshold up to the first at or above the
    highest can be answers. They are gathered per group into one sorted array and searched by
    an expression, so threshold rows are not shuffled on their group.
    """
    by = list(by)
    ends = thresholds.groupBy(*by).agg(F.min(threshold).alias("_lo"), F.max(threshold).alias("_hi"))
    near = steps.join(ends, by).filter(F.col(cumulative) >= F.col("_lo"))
    first_above = near.filter(F.col(cumulative) >= F.col("_hi")).groupBy(*by).agg(F.min(cumulative).alias("_stop"))
    usable = (
        near.join(first_above, by, "left")
        .filter(F.col("_stop").isNull() | (F.col(cumulative) <= F.col("_stop")))
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(cumulative).alias("c"), F.col(payload).alias("p")))).alias("_steps"))
    )
    hit = F.filter(F.col("_steps"), lambda s: s["c"] >= F.col(threshold))
    return (
        thresholds.join(usable, by, "left")
        .withColumn(payload, F.when(F.size(hit) > 0, F.try_element_at(hit, F.lit(1))["p"]))
        .drop("_steps")
    )
