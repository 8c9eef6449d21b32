"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

A source's rows are cut into blocks. With weight s/L, its k-th block (from 0) is released at slot
floor(k L / s) and due before slot ceil((k + 1) L / s); of the released blocks, the one due first takes
the slot. As the weights sum to one, every block meets its window, so after any number of slots t a source
has been served less than one block more or less than t s / L. The schedule repeats after L slots, so L
slots are computed once and the rest follows by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcal.llm.common import number_rows, saved, wrapped

#: Slots after which the schedule of few sources repeats; weights are whole multiples of 1 / RESOLUTION.
RESOLUTION = 1000
#: Slots per source up to which a period grows for the sake of sources that would have less than one slot.
SLOTS_PER_SOURCE = 16
BLOCK_ROWS = 16


def tempered_weights(docs: DataFrame, temperature: float, source: str = "source") -> DataFrame:
    """(source, weight): rows of each source to the power ``temperature``, as whole numbers (thousandths).

    1 keeps the shares that sources have, 0 makes them equal. A null source is a source.
    """
    counts = docs.groupBy(F.col(source).alias("source")).count()
    return counts.select("source", F.round(F.pow("count", F.lit(float(temperature))) * 1000).cast("long").alias("weight"))


def shares(weights: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """(source, idx, share): whole shares that sum to ``resolution``, at least one each, largest remainders first.

    Shares that would be zero are one, at the cost of the others in proportion to what they have beyond one. Sources are few
    (no more than the resolution, which is checked), so they are ranked in one task.
    """
    some = weights.where("weight > 0").groupBy("source").agg(F.sum("weight").cast("decimal(38,0)").alias("weight"))
    n = some.count()
    if n > resolution:
        raise ValueError(f"{n} sources need a resolution of {n} or more, not {resolution}")
    every = Window.partitionBy()
    total = F.sum("weight").over(every)
    raw = some.select(
        "source",
        F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())).alias("idx"),
        F.expr("weight * {0} div sum(weight) over ()".format(resolution)).cast("long").alias("whole"),
        (F.col("weight") * resolution % total).alias("rest"),
    )
    floored = raw.select("source", "idx", F.greatest("whole", F.lit(1)).alias("share"), F.when(F.col("whole") > 0, F.col("rest")).otherwise(-1).alias("rest"))
    lacking = floored.select("source", "idx", "share", "rest", (F.lit(resolution) - F.sum("share").over(every)).alias("lack"), F.sum(F.col("share") - 1).over(every).alias("beyond"))
    # Products of two counts of slots; what is taken sums to the lack, and no source has less than is taken from it.
    taken = lacking.select(
        "source", "idx", "share", "rest", "lack",
        F.expr("if(lack < 0, (share - 1) * -lack div beyond, 0)").alias("taken"),
        F.expr("if(lack < 0, (share - 1) * -lack % beyond, 0)").alias("left"),
    )
    ranked = taken.select(
        "source", "idx", "share", "lack", "taken",
        (-F.col("lack") - F.sum("taken").over(every)).alias("more"),
        F.row_number().over(Window.orderBy(F.desc("rest"), "idx")).alias("by_rest"),
        F.row_number().over(Window.orderBy(F.desc("left"), F.desc("share"), "idx")).alias("by_left"),
    )
    given = F.when(F.col("lack") >= 0, (F.col("by_rest") <= F.col("lack")).cast("long")).otherwise(-F.col("taken") - (F.col("by_left") <= F.col("more")).cast("long"))
    share = (F.col("share") + given).cast("long")
    return ranked.select("source", "idx", F.when(share >= 1, share).otherwise(F.raise_error(F.lit("a source has no slot")).cast("long")).alias("share"))


def fitting_resolution(weights: DataFrame) -> int:
    """Slots of a period in which the smallest weight has a whole one: ``RESOLUTION`` at least, ``SLOTS_PER_SOURCE`` per source at most.

    Where that most is reached, sources of less than a slot get one; all together they take less than one in ``SLOTS_PER_SOURCE``.
    """
    n, total, smallest = weights.where("weight > 0").groupBy("source").agg(F.sum("weight").cast("decimal(38,0)").alias("weight")).agg(F.count("*"), F.sum("weight"), F.min("weight")).first()
    return max(RESOLUTION, min(-(-int(total) // int(smallest)), SLOTS_PER_SOURCE * n)) if n else RESOLUTION


def schedule(shared: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """(idx, k, slot): which slot of a period each source's k-th block takes, earliest due first.

    A fold over the ``resolution`` slots of a period carries how many blocks each source has been served.
    """
    pick = f"""array_min(filter(
        transform(sizes, (s, i) -> named_struct('due', ceil((acc.served[i] + 1) * {resolution} / s), 'i', i, 'from', acc.served[i] * {resolution} div s)),
        x -> x.from <= t))"""
    step = f"""transform(array({pick}), p -> named_struct(
        'served', transform(acc.served, (v, i) -> if(i = p.i, v + 1, v)),
        'slots', concat(acc.slots, array(p.i))))[0]"""
    fold = f"""aggregate(sequence(0, {resolution} - 1),
        named_struct('served', transform(sizes, s -> 0L), 'slots', cast(array() as array<int>)),
        (acc, t) -> {step}, acc -> acc.slots)"""
    one = shared.agg(F.expr("transform(array_sort(collect_list(struct(idx, share))), x -> x.share)").alias("sizes"))
    slots = one.where(F.size("sizes") > 0).select(F.posexplode(F.expr(fold)).alias("slot", "i"))
    order = Window.partitionBy("i").orderBy("slot")
    return slots.select((F.col("i") + 1).alias("idx"), (F.row_number().over(order) - 1).cast("long").alias("k"), F.col("slot").cast("long"))


def mix(
    docs: DataFrame,
    weights: DataFrame,
    by: list[str],
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
    resolution: int | None = None,
    until: str = "all",
) -> DataFrame:
    """Every scheduled row of ``docs`` with ``epoch``, ``slot`` and ``place``; order by (slot, place) to read the mix.

    A source's rows are numbered in the order of ``by`` and cut into blocks of ``block_rows`` (its last may be shorter).
    ``until="all"`` ends when each source has been served whole once; a source that is used up before starts its next
    epoch, so its rows are repeated, and no row is left out. ``until="first"`` ends with the first source that is
    used up; rows beyond are not scheduled. A source of no or zero weight is not scheduled; a null source is a source.
    Rows equal in ``by`` and source are interchangeable. An empty table gives no rows. Columns named as the new ones are
    replaced.

    A hot source is no group anywhere: rows are numbered by one global order, and the schedule (``resolution`` rows;
    by default as many as ``fitting_resolution`` says) and the sources (no more) are broadcast.
    """
    if until not in ("all", "first"):
        raise ValueError("until must be 'all' or 'first'")
    new = ("epoch", "slot", "place")
    keyed = docs.select(wrapped(docs), F.col(source).alias("source"), *[F.col(c).alias(f"by_{i}") for i, c in enumerate(by)])
    numbered = saved(number_rows(keyed, ["source", *[f"by_{i}" for i in range(len(by))]], "__row").select("doc", "source", "__row"), "mix-rows")
    counts = numbered.groupBy("source").agg(F.count("*").alias("rows"), F.min("__row").alias("first"))
    weights = saved(weights, "mix-weights")
    resolution = resolution or fitting_resolution(weights)
    shared = saved(shares(weights, resolution), "mix-shares")
    period = saved(schedule(shared, resolution), "mix-schedule")
    blocks = F.expr(f"(rows + {block_rows} - 1) div {block_rows}")
    known = shared.withColumnRenamed("source", "__s").join(counts.withColumnRenamed("source", "__c"), F.col("__s").eqNullSafe(F.col("__c"))).select("__s", "idx", "share", "first", blocks.alias("blocks"))
    # The slot after a source's last block ends its first epoch.
    last = known.withColumn("k", F.expr("(blocks - 1) % share")).join(F.broadcast(period), ["idx", "k"])
    ends = F.expr(f"(blocks - 1) div share * {resolution} + slot + 1")
    end = last.agg((F.max if until == "all" else F.min)(ends).alias("slots"))
    # Blocks served in the last, broken period.
    broken = period.crossJoin(F.broadcast(end)).where(F.expr(f"slot < slots % {resolution}")).groupBy("idx").agg(F.count("*").alias("more"))
    served = (
        known.crossJoin(F.broadcast(end)).join(F.broadcast(broken), "idx", "left")
        .select("__s", "idx", "share", "first", "blocks", F.expr(f"slots div {resolution} * share + coalesce(more, 0)").alias("served"))
    )
    inside = numbered.join(F.broadcast(saved(served, "mix-sources")), F.col("source").eqNullSafe(F.col("__s")))
    block = F.expr(f"(__row - first) div {block_rows}")
    placed = inside.withColumn("__b", block).where("__b < served").withColumn("epoch", F.explode(F.expr("sequence(0L, (served - 1 - __b) div blocks)")))
    turn = placed.withColumn("__turn", F.expr("epoch * blocks + __b")).withColumn("k", F.expr("__turn % share"))
    at = turn.join(F.broadcast(period.withColumnRenamed("slot", "__slot")), ["idx", "k"])
    return at.select(
        *[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in new],
        "epoch",
        F.expr(f"__turn div share * {resolution} + __slot").alias("slot"),
        F.expr(f"cast((__row - first) % {block_rows} as int)").alias("place"),
    )
