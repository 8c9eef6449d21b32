"""Adaptive conformal intervals over a stream, equal to the batch trace.

A step needs three numbers of its calibration cell: how many scores there are, how many would miss its
outcome, and the score at the rank it asks for. The first two are joined to the rows before the stateful step, the third
to its output (``lookup``), so the fold itself carries one level per key and holds no scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.operators.adaptive import (
    ALPHA_MAX,
    ALPHA_MIN,
    GAMMA,
    check_parameters,
    covering_score,
    next_alpha,
    rank_of,
    regime_of,
)
from panelcal.operators.conformal import CLAMP, RAISE
from panelcal.streaming.lookup import ScoreIndex
from panelcal.streaming.ordered import LATE, OK, OrderedProcessor, Run, run_behind, run_ordered

UNKNOWN, HELD = "outcome_without_prediction", "held"
PREDICT, OUTCOME, REPORT = 0, 1, 2
STEP = (
    "seq bigint, center double, truth double, alpha_used double, alpha_next double, requested_rank bigint, effective_rank bigint, "
    "finite_rank_attainable boolean, quantile_regime string, miss boolean, status string"
)
STEP_COLUMNS = [part.split()[0] for part in STEP.split(", ")]
#: State between the rows of a key: the level, the open prediction and the ends of the queue behind it.
LEVEL = "alpha double, open boolean, seq bigint, center double, rank bigint, n bigint, head bigint, tail bigint"


class _Adaptive(OrderedProcessor):
    def __init__(self, keys, payload, gamma, low, high, policy) -> None:
        super().__init__(payload, [*keys, *STEP_COLUMNS])
        self.keys = list(keys)
        self.gamma, self.low, self.high, self.policy = gamma, low, high, policy

    def start(self, handle) -> None:
        self.level = handle.getValueState("level", LEVEL)

    def _nominal(self, key: tuple) -> float:
        return float(dict(zip(self.keys, key, strict=True))["alpha"])

    def _ranks(self, alpha: float, n: int) -> tuple:
        rank = rank_of(alpha, n)
        effective = rank if rank <= n else (n if self.policy == CLAMP and n else None)
        if effective is None and self.policy == RAISE:
            raise ValueError(f"requested conformal rank {rank} is unattainable with {n} scores")
        return rank, effective, rank <= n, regime_of(rank, n)

    def _follow(self, alpha: float, nominal: float, effective: int | None, below: float) -> tuple[float, bool]:
        """The next level, and whether the score at the rank misses: it does if it is among those below the covering score."""
        missed = effective is not None and below >= effective
        return next_alpha(alpha, nominal, missed, self.gamma, self.low, self.high), missed

    def late(self, key, run, watermark):
        return [(*key, int(s), *_known(v[:2]), *[None] * 7, LATE) for s, v in zip(run.seq, run.values, strict=True)]


def _known(values) -> list[float | None]:
    return [None if np.isnan(v) else float(v) for v in values]


class AdaptiveStream(_Adaptive):
    """Each row carries its centre and, for the update after it, its outcome."""

    def __init__(self, keys, *rest) -> None:
        super().__init__(keys, ["center", "truth", "below", "n"], *rest)

    def advance(self, key, run, passed):
        nominal = self._nominal(key)
        alpha = float(self.level.get()[0]) if self.level.exists() else nominal
        out = []
        for seq, (center, truth, below, n) in zip(run.seq.tolist(), run.values.tolist(), strict=True):
            rank, effective, fits, regime = self._ranks(alpha, int(n))
            following, missed = self._follow(alpha, nominal, effective, below)
            out.append((*key, seq, center, truth, alpha, following, rank, effective, fits, regime, missed, OK))
            alpha = following
        self.level.update((alpha, False, 0, 0.0, 0, 0, 0, 0))
        return out


class PairOutcomes(OrderedProcessor):
    """Gives each outcome the centre of its prediction, null if there was none before it.

    Late rows go on as reports, with the time at which they are reported.
    """

    def __init__(self, keys) -> None:
        super().__init__(["center", "truth"], [*keys, "ts", "seq", "kind", "center", "truth"])

    def start(self, handle) -> None:
        self.asked = handle.getMapState("asked", "seq bigint", "center double")

    def advance(self, key, run, passed):
        out, asked = [], {}
        for ts, seq, kind, (center, truth) in zip(run.ts.tolist(), run.seq.tolist(), run.kind.tolist(), run.values.tolist(), strict=True):
            if kind == PREDICT:
                asked[seq] = center
            else:
                center = asked.pop(seq, None)
                if center is None and self.asked.containsKey((seq,)):
                    center = float(self.asked.getValue((seq,))[0])
                    self.asked.removeKey((seq,))
            out.append((*key, np.datetime64(ts, "ms"), seq, kind, center, None if np.isnan(truth) else truth))
        for seq, center in asked.items():
            self.asked.updateValue((seq,), (center,))
        return out

    def late(self, key, run, watermark):
        at = np.datetime64(watermark + 1, "ms")
        return [(*key, at, int(s), REPORT, *_known(v)) for s, v in zip(run.seq, run.values, strict=True)]


class PrequentialStream(_Adaptive):
    """Predictions and outcomes as separate events.

    A prediction is answered from the current level; the next ones wait, in a queue with a head and a tail number, until
    the outcome of the open one has arrived. An outcome that fits no open prediction is reported and changes nothing.
    """

    at_once = REPORT

    def __init__(self, keys, *rest) -> None:
        super().__init__(keys, ["center", "truth", "below", "n"], *rest)

    def start(self, handle) -> None:
        super().start(handle)
        self.waiting = handle.getMapState("waiting", "at bigint", "seq bigint, center double, n bigint")

    def advance(self, key, run: Run, passed):
        nominal = self._nominal(key)
        alpha, is_open, open_seq, open_center, open_rank, open_n, head, tail = self.level.get() if self.level.exists() else (nominal, False, 0, 0.0, 0, 0, 0, 0)
        out: list[tuple] = []

        def predict(seq: int, center: float, n: int, status: str) -> tuple:
            rank, effective, fits, regime = self._ranks(alpha, n)
            out.append((*key, seq, center, None, alpha, None, rank, effective, fits, regime, None, status))
            return True, seq, center, effective or 0, n

        for seq, kind, (center, truth, below, n) in zip(run.seq.tolist(), run.kind.tolist(), run.values.tolist(), strict=True):
            if kind == PREDICT:
                if is_open:
                    self.waiting.updateValue((tail,), (seq, center, int(n)))
                    tail += 1
                else:
                    is_open, open_seq, open_center, open_rank, open_n = predict(seq, center, int(n), OK)
            elif not is_open or open_seq != seq:
                out.append((*key, seq, None, truth, *[None] * 7, UNKNOWN))
            else:
                rank, _, fits, regime = self._ranks(alpha, open_n)
                following, missed = self._follow(alpha, nominal, open_rank or None, below)
                out.append((*key, seq, open_center, truth, alpha, following, rank, open_rank or None, fits, regime, missed, OK))
                alpha, is_open = following, False
                if head < tail:
                    held = self.waiting.getValue((head,))
                    self.waiting.removeKey((head,))
                    head += 1
                    is_open, open_seq, open_center, open_rank, open_n = predict(int(held[0]), float(held[1]), int(held[2]), HELD)
        self.level.update((alpha, is_open, open_seq, open_center, open_rank, open_n, head, tail))
        return out


def _key_schema(stream: DataFrame, keys: Sequence[str]) -> str:
    types = dict(stream.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def adaptive_stream(
    stream: DataFrame,
    scores: ScoreIndex,
    keys: Sequence[str],
    *,
    delay: str = "10 seconds",
    gamma: float = GAMMA,
    alpha_min: float = ALPHA_MIN,
    alpha_max: float = ALPHA_MAX,
    policy: str = CLAMP,
    separate_outcomes: bool = False,
) -> DataFrame:
    """Adaptive trace of a stream with columns ts, seq, center, truth, alpha and the keys.

    ``keys`` include ``alpha`` and the cell columns of ``scores``. With ``separate_outcomes`` rows also carry ``kind`` (0 predict,
    1 outcome). Rows behind what their key has answered come out with status ``late`` and no interval; emitted intervals
    never change.
    """
    check_parameters([], gamma, alpha_min, alpha_max, policy)
    options = (gamma, alpha_min, alpha_max, policy)
    schema = _key_schema(stream, keys)
    need = covering_score(F.col("center"), F.col("truth"))
    if separate_outcomes:
        paired = run_ordered(stream, keys, PairOutcomes(keys), f"{schema}, ts timestamp, seq bigint, kind int, center double, truth double", delay=delay, event_time="ts")
        counted = scores.with_counts(paired.withColumn("_need", need), F.col("_need")).drop("_need")
        steps = run_behind(counted, keys, PrequentialStream(keys, *options), f"{schema}, {STEP}")
    else:
        counted = scores.with_counts(stream.withColumn("_need", need), F.col("_need")).drop("_need")
        steps = run_ordered(counted, keys, AdaptiveStream(keys, *options), f"{schema}, {STEP}", delay=delay)
    found = scores.with_score_at(steps, "effective_rank", "quantile")
    answered = F.col("requested_rank").isNotNull()
    quantile = F.when(answered, F.coalesce("quantile", F.lit(float("inf"))))
    bounded = found.withColumn("quantile", quantile).withColumn("lower", F.col("center") - F.col("quantile")).withColumn("upper", F.col("center") + F.col("quantile"))
    return bounded.select(*keys, *STEP_COLUMNS[:5], "quantile", "lower", "upper", *STEP_COLUMNS[5:])
