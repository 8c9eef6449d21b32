"""Remaining-life labels, endpoint rows and the truth joins built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.functions.expressions import RUL_CAP, absolute_residual, clip
from panelcal.schema import CYCLE, ENTITY, ContractError, require


def last_cycles(panel: DataFrame, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Complete life of each entity, by partial aggregation over two columns."""
    return panel.groupBy(*by).agg(F.max(CYCLE).alias("last_cycle"))


def add_labels(panel: DataFrame, *, cap: int | None = RUL_CAP, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """``rul_raw`` = cycles left until the entity's last row; ``rul_capped`` bounded by ``cap``.

    The maximum is aggregated and joined back rather than taken over a window: a long entity
    is then combined map side, and its join partition can be split.
    """
    require(panel, [*by, CYCLE])
    if cap is not None and cap <= 0:
        raise ContractError("the label cap must be positive")
    out = panel.join(last_cycles(panel, by), list(by)).withColumn(
        "rul_raw", (F.col("last_cycle") - F.col(CYCLE)).cast("bigint")
    )
    if cap is not None:
        out = out.withColumn("rul_capped", F.least(F.col("rul_raw"), F.lit(cap)).cast("bigint"))
    return out.drop("last_cycle")


def endpoints(panel: DataFrame, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """The row of the greatest cycle per entity."""
    rest = [c for c in panel.columns if c not in by]
    return panel.groupBy(*by).agg(F.max_by(F.struct(*rest), CYCLE).alias("_r")).select(*by, "_r.*")


def endpoints_at(panel: DataFrame, cuts: DataFrame, by: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Endpoint rows of many prefixes at once, with no aggregate.

    ``panel`` carries ``next_cycle`` (the entity's following cycle, null on its last row, as
    the feature pass emits it). A row ends the prefix of ``cut`` when it lies at or before the
    cut and its successor does not.
    """
    require(panel, ["next_cycle"])
    hit = (F.col(CYCLE) <= F.col("cut")) & (F.col("next_cycle").isNull() | (F.col("next_cycle") > F.col("cut")))
    return panel.join(cuts, list(by)).filter(hit)


def score_endpoints(rows: DataFrame, *, cap: int = RUL_CAP, prediction: str = "pred_raw") -> DataFrame:
    """Clipped centre and absolute residual of the capped truth from it."""
    return rows.withColumn("pred", clip(prediction, 0.0, float(cap))).withColumn(
        "score", absolute_residual("rul_capped", "pred")
    )
