"""Adaptive conformal intervals in batch.

Within a stream the miscoverage level moves after every outcome, so the path is sequential by
definition. What a step needs from the calibration set is only *how many* scores would miss
its outcome. That count is looked up for all rows at once (a running count), the sequential
fold then carries one number per stream, and the quantile values are joined back on their
rank. Neither the calibration set nor a stream is ever held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcal.functions.expressions import INTERIOR, MAX_STATISTIC, UNATTAINABLE
from panelcal.operators.conformal import CLAMP, INFINITE, RAISE
from panelcal.operators.ranks import count_and_sum_up_to, distributed_rank
from panelcal.schema import ContractError

# Fixed values of the adaptive protocol.
GAMMA, ALPHA_MIN, ALPHA_MAX = 0.01, 0.001, 0.999

TRACE = (
    "alpha_used double, alpha_next double, requested_rank bigint, effective_rank bigint, "
    "finite_rank_attainable boolean, quantile_regime string, miss boolean"
)


def check_parameters(alphas: Sequence[float], gamma: float, low: float, high: float, policy: str) -> None:
    if gamma <= 0 or not 0 < low < high < 1 or any(not low <= a <= high for a in alphas):
        raise ContractError("adaptive parameters are invalid")
    if policy not in (RAISE, INFINITE, CLAMP):
        raise ContractError(f"unknown policy: {policy}")


def smallest_covering_score(center: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Least double s >= 0 with center - s <= truth <= center + s in floating arithmetic.

    Rounding is monotone, so what covers is an upper set, and the bit patterns of doubles from zero to
    infinity are ordered as they are: 64 halvings find the least one, however far it is from the residual.
    """
    low = np.full(len(center), -1, np.int64)
    high = np.full(len(center), np.array(np.inf).view(np.int64), np.int64)
    for _ in range(64):
        middle = low + (high - low) // 2
        v = np.maximum(middle, 0).view(np.float64)
        covers = (middle >= 0) & (truth >= center - v) & (truth <= center + v)
        open_ = high - low > 1
        high = np.where(open_ & covers, middle, high)
        low = np.where(open_ & ~covers, middle, low)
    return high.view(np.float64)


@F.pandas_udf(T.DoubleType())
def covering_score(center: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series(smallest_covering_score(center.to_numpy("float64"), truth.to_numpy("float64")))


def rank_of(alpha: float, n: int) -> int:
    return int(np.ceil((n + 1.0) * (1.0 - alpha)))


def next_alpha(alpha: float, nominal: float, missed: bool, gamma: float, low: float, high: float) -> float:
    return min(max(alpha + gamma * (nominal - (1.0 if missed else 0.0)), low), high)


def regime_of(rank: int, n: int) -> str:
    return INTERIOR if rank < n else MAX_STATISTIC if rank == n else UNATTAINABLE


def adaptive_trace(
    targets: DataFrame,
    scores: DataFrame,
    cell: Sequence[str],
    stream: Sequence[str],
    alphas: Sequence[float],
    *,
    order: str = "seq",
    center: str = "pred",
    truth: str = "y_true",
    gamma: float = GAMMA,
    alpha_min: float = ALPHA_MIN,
    alpha_max: float = ALPHA_MAX,
    policy: str = CLAMP,
    slices: int | None = None,
) -> DataFrame:
    """Prequential intervals: predict from the current alpha, see the outcome, update alpha.

    ``cell`` keys the calibration scores, ``stream`` (which includes ``cell``) the sequences.
    Adds alpha, bounds, quantile and the trace columns. A miss is strictly outside the bounds.
    """
    check_parameters(alphas, gamma, alpha_min, alpha_max, policy)
    cell, stream = list(cell), list(stream)
    if not set(cell) <= set(stream):
        raise ContractError("a stream belongs to one calibration cell")
    points = targets.withColumn("_need", covering_score(F.col(center).cast("double"), F.col(truth).cast("double")))
    values = scores.select(*cell, F.col("score").alias("_need"))
    sizes = values.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    below = count_and_sum_up_to(points.select(*cell, "_need"), values, cell, "_need", strict=True, slices=slices)
    located = points.join(below.select(*cell, "_need", F.col("rows_upto").alias("_below")), [*cell, "_need"]).join(
        sizes, cell
    )
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    rows = located.withColumn("alpha", F.explode(grid)).drop("_need")
    key = [*stream, "alpha"]
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(TRACE).fields])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, alpha = None, 0.0
        for batch in batches:
            trace = []
            keys = batch[key].itertuples(index=False, name=None)
            for k, below_n, n, nominal in zip(keys, batch["_below"], batch["_n"], batch["alpha"], strict=True):
                if k != current:
                    current, alpha = k, nominal
                rank = rank_of(alpha, n)
                effective = rank if rank <= n else (n if policy == CLAMP else None)
                if effective is None and policy == RAISE:
                    raise ValueError(f"requested conformal rank {rank} is unattainable with {n} scores")
                # The score at this rank misses when it is among those below the covering score.
                missed = effective is not None and below_n >= effective
                following = next_alpha(alpha, nominal, missed, gamma, alpha_min, alpha_max)
                trace.append((alpha, following, rank, effective, rank <= n, regime_of(rank, n), missed))
                alpha = following
            names = [f.name for f in schema.fields[len(kept) :]]
            extra = pd.DataFrame(trace, columns=names, index=batch.index)
            extra["effective_rank"] = extra["effective_rank"].astype("Int64")
            yield pd.concat([batch, extra], axis=1)

    traced = rows.repartition(*key).sortWithinPartitions(*key, order).mapInPandas(fold, schema)
    ranked = distributed_rank(values, cell, "_need", [], out="effective_rank", slices=slices).select(
        *cell, F.col("effective_rank").cast("bigint").alias("effective_rank"), F.col("_need").alias("quantile")
    )
    return (
        traced.drop("_below", "_n")
        .join(ranked, [*cell, "effective_rank"], "left")
        .withColumn("quantile", F.coalesce("quantile", F.lit(float("inf"))))
        .withColumn("lower", F.col(center) - F.col("quantile"))
        .withColumn("upper", F.col(center) + F.col("quantile"))
    )
