"""Entity-level roles and prefix cut points from hashed keys.

The role of an entity and its cut depend on nothing but the seed, the id and the entity's
own last cycle, so no partitioning, retry or row order can change them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcal.functions.expressions import hash_bits, uniform_int
from panelcal.operators.ranks import order_statistics
from panelcal.schema import CYCLE, ENTITY, ContractError
from panelcal.session import local_rows

# Fixed values of the evaluation protocol.
SEEDS = (13, 37, 73, 101, 137)
TRAIN, CALIBRATION, VALIDATION = "base_train", "calibration", "validation"
MIN_OBSERVED, LOWER_FRACTION, UPPER_FRACTION = 30, 0.40, 0.90
CONDITIONS = (
    ("primary", 125, 30, 0.40, 0.90),
    ("cap_130", 130, 30, 0.40, 0.90),
    ("early_calibration", 125, 30, 0.40, 0.65),
    ("late_calibration", 125, 30, 0.65, 0.90),
)
CONDITION_SCHEMA = "condition string, cap int, min_observed int, lower_fraction double, upper_fraction double"


def seed_table(spark: SparkSession, seeds: Sequence[int] = SEEDS) -> DataFrame:
    if any(s < 0 for s in seeds):
        raise ContractError("seeds must be nonnegative")
    return local_rows(spark, [(int(s),) for s in seeds], "seed int")


def condition_table(spark: SparkSession, conditions: Sequence[tuple] = CONDITIONS) -> DataFrame:
    for _, cap, least, low, high in conditions:
        if cap <= 0 or least < 1 or not 0 < low <= high <= 1:
            raise ContractError("invalid cut-point condition")
    return local_rows(spark, [tuple(c) for c in conditions], CONDITION_SCHEMA)


def assign_roles(
    entities: DataFrame,
    seeds: Sequence[int] = SEEDS,
    *,
    train_fraction: float = 0.60,
    calibration_fraction: float = 0.20,
    id_column: str = ENTITY,
) -> DataFrame:
    """Rows (seed, entity, role): the first floor(0.6 n) entities in hash order train, the next
    floor(0.2 n) calibrate, the rest validate.

    Only the hash keys at those two counts are looked up exactly; no entity is ranked. A seed
    with fewer than five entities, or with none left to validate, raises when it runs.
    """
    if not (0 < train_fraction < 1 and 0 < calibration_fraction < 1 and train_fraction + calibration_fraction < 1):
        raise ContractError("split fractions must leave validation entities")
    spark = entities.sparkSession
    ids = entities.select(id_column).distinct()
    keyed = ids.crossJoin(F.broadcast(seed_table(spark, seeds))).withColumn("_h", hash_bits("seed", id_column))

    def bounds(sizes: DataFrame) -> DataFrame:
        train = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(train_fraction)))
        calibration = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(calibration_fraction)))
        checked = F.when(
            (F.col("n") >= 5) & (train + calibration < F.col("n")), train
        ).otherwise(F.raise_error(F.lit("at least 5 entities, some left for validation, are required")))
        ranks = F.array(
            F.struct(F.lit("train").alias("bound"), checked.alias("rank")),
            F.struct(F.lit("calibration").alias("bound"), (checked + calibration).alias("rank")),
        )
        return sizes.withColumn("_b", F.explode(ranks)).select("seed", "n", "_pivots", "_b.bound", "_b.rank")

    found = order_statistics(keyed, ["seed"], "_h", bounds, tie=[id_column], bounded_cells=True, all_valid=True)
    ends = found.groupBy("seed").agg(
        *[
            F.max(F.when(F.col("bound") == b, F.struct(F.col("_h"), F.col(id_column)))).alias(f"_{b}")
            for b in ("train", "calibration")
        ]
    )
    key = F.struct(F.col("_h"), F.col(id_column))
    role = F.when(key <= F.col("_train"), TRAIN).when(key <= F.col("_calibration"), CALIBRATION).otherwise(VALIDATION)
    # One row per declared seed.
    return keyed.join(F.broadcast(ends), "seed").select("seed", id_column, role.alias("role"))


def fit_reservoir_roles(assignment: DataFrame) -> DataFrame:
    """Two-role view: train stays ``fit``; calibration and validation form the reservoir."""
    return assignment.select(
        "*",
        F.when(F.col("role") == TRAIN, "fit").otherwise("reservoir").alias("audit_role"),
        F.when(F.col("role") == CALIBRATION, "former_calibration")
        .when(F.col("role") == VALIDATION, "former_validation")
        .alias("origin_role"),
    )


def with_role(panel: DataFrame, assignment: DataFrame, role: str, *, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Rows of the entities that hold ``role`` (of one seed: filter ``assignment`` first)."""
    return panel.join(assignment.filter(F.col("role") == role).select(*by).distinct(), list(by), "left_semi")


def cut_points(
    lives: DataFrame, grid: DataFrame, *, by: Sequence[str] = (ENTITY,), strict: bool = True
) -> DataFrame:
    """One observed-cycle cut per (seed, condition, entity).

    ``lives`` holds (entity, last_cycle); ``grid`` the declared seeds and conditions
    (seed, condition, cap, min_observed, lower_fraction, upper_fraction). The cut is uniform in
    [max(min_observed, ceil(lower L)), floor(upper L)] with L the greatest cycle. An entity
    without such a cycle raises, or is left out when ``strict`` is off.
    """
    low = F.greatest(
        F.col("min_observed").cast("bigint"), F.ceil(F.col("last_cycle").cast("double") * F.col("lower_fraction"))
    )
    high = F.floor(F.col("last_cycle").cast("double") * F.col("upper_fraction"))
    ranged = lives.crossJoin(F.broadcast(grid)).withColumn("_low", low).withColumn("_high", high)
    drawn = uniform_int(F.col("_low"), F.col("_high"), "seed", "condition", *by)
    if strict:
        value = F.when(F.col("_low") <= F.col("_high"), drawn).otherwise(
            F.raise_error(F.lit("an entity has no valid cut-point range"))
        )
    else:
        ranged = ranged.filter(F.col("_low") <= F.col("_high"))
        value = drawn
    return ranged.select("seed", "condition", "cap", *by, value.alias("cut"))


def restrict_to_cuts(panel: DataFrame, cuts: DataFrame, *, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Prefix rows ``cycle <= cut``; entities without a cut are left out."""
    return panel.join(cuts, list(by)).filter(F.col(CYCLE) <= F.col("cut"))
