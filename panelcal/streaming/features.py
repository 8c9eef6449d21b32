"""Window features and frozen-model scores over a stream, equal to the batch pass.

State per entity is the rows its longest window still reaches: the last max(windows) - 1. Entities share keys of state by
their hash: a key costs its state calls and its frame whatever it holds, and there may be millions of entities.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.operators.features import WINDOWS, feature_names, window_columns
from panelcal.plans.frozen import FrozenConformal
from panelcal.schema import CYCLE, ENTITY, SETTINGS
from panelcal.streaming.ordered import LATE, OK, OrderedProcessor, Run, run_ordered

KEYS = 2048
RECENT = "entity array<bigint>, passed array<bigint>, held array<bigint>, v array<double>"


def window_values(
    history: np.ndarray, new: int | Sequence[int], windows: Sequence[int] | None = None, position: np.ndarray | None = None
) -> list[np.ndarray]:
    """Of the last ``new`` rows: delta, then mean, population std and slope of each window, as (new x sensors) arrays, NaN for none.

    ``position`` numbers the rows of each entity from 0, where there are several; a window that reaches beyond an entity's first
    row is as short as the rows there are. ``window_values(series, windows)`` gives the values of the last row of one series.
    """
    if windows is None:
        return [v[0, 0] for v in window_values(np.reshape(history, (-1, 1)), 1, new)]
    n, width = history.shape
    known = np.concatenate([np.zeros((max(windows) - 1, width), bool), ~np.isnan(history)])
    values = np.concatenate([np.zeros((max(windows) - 1, width)), np.nan_to_num(history, posinf=np.inf, neginf=-np.inf)])
    made = window_columns(values, known, np.arange(n) if position is None else position, windows)
    return [np.ma.filled(m, np.nan)[n - new :] for m in made]


def _places(entity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row among those of its entity, from the first and from the last; ``entity`` is sorted."""
    at = np.arange(len(entity))
    return at - np.searchsorted(entity, entity, "left"), np.searchsorted(entity, entity, "right") - 1 - at


class FeatureStream(OrderedProcessor):
    kind_column = ENTITY

    def __init__(self, settings: Sequence[str], sensors: Sequence[str], windows: Sequence[int]) -> None:
        self.settings, self.sensors, self.windows = list(settings), list(sensors), list(windows)
        self.names = feature_names(sensors, settings, windows)
        super().__init__([*settings, *sensors], [ENTITY, CYCLE, *self.names, "status"])

    def start(self, handle) -> None:
        self.recent = handle.getValueState("recent", RECENT)

    def _recent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The key's entities in order, the time each has answered, how many rows of each are kept, and those rows."""
        entity, passed, held, v = self.recent.get() if self.recent.exists() else ((), (), (), ())
        whole = [np.array(x, np.int64) for x in (entity, passed, held)]
        return *whole, np.array(v, np.float64).reshape(-1, len(self.sensors))

    def answered(self, run: Run) -> np.ndarray:
        entity, passed, _, _ = self._recent()
        at = np.searchsorted(entity, run.kind)
        found = np.append(entity, 0)[at] == run.kind
        return np.where(found & (at < len(entity)), np.append(passed, -1)[at], -1)

    def _rows(self, run: Run, derived: list[np.ndarray], status: str) -> pd.DataFrame:
        given = {name: run.values[:, i] for i, name in enumerate(self.payload)}
        # Per sensor, as the names go: delta, then three of each window.
        made = dict(zip(self.names[len(given) : -1], [d[:, i] for i in range(len(self.sensors)) for d in derived], strict=False))
        missing = {name: np.full(len(run), np.nan) for name in self.names[len(given) : -1] if name not in made}
        columns = {ENTITY: run.kind, CYCLE: run.seq, **given, **made, **missing, "cycle_index": run.seq.astype(float), "status": status}
        return pd.DataFrame(columns, index=range(len(run)))[self.columns]

    def advance(self, key, run, passed):
        run = run[np.argsort(run.kind, kind="stable")]
        entity, times, held, kept = self._recent()
        owner = np.repeat(entity, held)
        known = np.unique(run.kind)
        # Kept rows come before new ones of their entity; entities without new rows stay as they are.
        touched = np.isin(owner, known)
        ids = np.concatenate([owner[touched], run.kind])
        order = np.argsort(ids, kind="stable")
        history = np.concatenate([kept[touched], run.values[:, len(self.settings) :]])[order]
        first, last = _places(ids[order])
        fresh = order >= touched.sum()
        made = [v[fresh] for v in window_values(history, len(history), self.windows, first)]
        stays = last < max(self.windows) - 1
        self._keep(
            np.concatenate([entity[~np.isin(entity, known)], known]),
            np.concatenate([times[~np.isin(entity, known)], np.full(len(known), passed)]),
            np.concatenate([owner[~touched], ids[order][stays]]),
            np.concatenate([kept[~touched], history[stays]]),
        )
        return self._rows(run, made, OK)

    def _keep(self, entity: np.ndarray, times: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> None:
        by, rows = np.argsort(entity, kind="stable"), rows[np.argsort(owner, kind="stable")]
        entity, owner = entity[by], np.sort(owner)
        held = np.searchsorted(owner, entity, "right") - np.searchsorted(owner, entity, "left")
        self.recent.update((entity.tolist(), times[by].tolist(), held.tolist(), rows.ravel().tolist()))

    def late(self, key, run, watermark):
        return self._rows(run, [], LATE)


def feature_stream(
    stream: DataFrame, sensors: Sequence[str], *, settings: Sequence[str] = SETTINGS, windows: Sequence[int] = WINDOWS, delay: str = "10 seconds"
) -> DataFrame:
    """Features of a panel stream with columns entity_id, ts, seq (the cycle), settings and sensors.

    Rows behind those their entity has drained come out with status ``late`` and no derived features.
    """
    names = feature_names(sensors, settings, windows)
    shared = stream.withColumn("_key", F.pmod(F.xxhash64(ENTITY), F.lit(KEYS)).cast("int"))
    schema = ", ".join([f"{ENTITY} bigint", f"{CYCLE} bigint", *[f"{n} double" for n in names], "status string"])
    return run_ordered(shared, ["_key"], FeatureStream(settings, sensors, windows), schema, delay=delay)


def scored_stream(features: DataFrame, frozen: FrozenConformal) -> DataFrame:
    """(entity_id, cycle, model, pred_raw, pred) of every on-time row of ``feature_stream`` by each model of a frozen fit, in the same query."""
    on_time = features.where(F.col("status") == OK)
    return frozen.predict(on_time.select(ENTITY, CYCLE, *[f for f in frozen.features if f != CYCLE]), [ENTITY, CYCLE])
