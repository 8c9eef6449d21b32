"""Rows of a key processed in event order, whatever order micro-batches bring them in.

Rows wait in state until the watermark passes them and are then handed on sorted by
(event time, sequence number). State per key is the rows inside the watermark delay, packed as
arrays, plus what the subclass keeps. Each key does a few state calls per micro-batch, not per row.

Nothing is dropped. The watermark rests on a clock column of its own: every row comes twice to the
watermark node, once as a tick that bears its event time and ends there, once as data without a
clock, which Spark never holds to be late. A row behind what its key has already answered comes
out at once, marked late, and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OK, LATE = "ok", "late"


@dataclass(frozen=True)
class Run:
    """Rows of one key as arrays; ``values`` has a column per payload name, null as NaN.

    ``kind`` tells rows of one time and number apart: predictions and outcomes, or entities where a key holds many.
    """

    ts: np.ndarray
    seq: np.ndarray
    kind: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.ts)

    def __getitem__(self, at: np.ndarray) -> Run:
        return Run(self.ts[at], self.seq[at], self.kind[at], self.values[at])

    def packed(self) -> tuple:
        return self.ts.tolist(), self.seq.tolist(), self.kind.tolist(), self.values.ravel().tolist()

    @staticmethod
    def joined(parts: list[tuple], width: int) -> Run:
        ts, seq, kind = (np.concatenate([np.asarray(p[i], np.int64) for p in parts]) for i in range(3))
        return Run(ts, seq, kind, np.concatenate([np.asarray(p[3], np.float64).reshape(-1, width) for p in parts]))

    def in_order(self) -> Run:
        """Sorted by (ts, seq, kind); of rows that repeat these the last to arrive stays."""
        order = np.lexsort((self.kind, self.seq, self.ts))
        key = np.column_stack([self.ts, self.seq, self.kind])[order]
        last = np.append((key[1:] != key[:-1]).any(axis=1), True) if len(order) else np.zeros(0, bool)
        return self[order[last]]


class OrderedProcessor(StatefulProcessor):
    """Buffers rows and drains those at or before the watermark, in order.

    ``payload`` names the buffered columns, which are doubles. ``advance`` receives the key, the
    drained rows and the watermark, ``late`` those behind the rows that the key has drained; both return output rows in
    the order of ``columns``, as tuples or as a frame. Rows of the kind ``at_once`` count as late, whatever their time.
    ``kind_column`` names the column of the kinds, if there is one.
    """

    at_once: int | None = None
    kind_column = "kind"

    def __init__(self, payload: Sequence[str], columns: Sequence[str]) -> None:
        self.payload = list(payload)
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "ts array<bigint>, seq array<bigint>, kind array<bigint>, payload array<double>")
        self.passed = handle.getValueState("passed", "ms bigint")
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Open further state."""

    def advance(self, key: tuple, run: Run, passed: int) -> list[tuple] | pd.DataFrame:
        raise NotImplementedError

    def late(self, key: tuple, run: Run, watermark: int) -> list[tuple] | pd.DataFrame:
        raise NotImplementedError

    def answered(self, run: Run) -> int | np.ndarray:
        """The time up to which rows like these have been answered, -1 for none."""
        return int(self.passed.get()[0]) if self.passed.exists() else -1

    def _frame(self, rows: list[tuple] | pd.DataFrame) -> pd.DataFrame:
        return rows if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            millis = batch["ts"].astype("int64").to_numpy() // (1_000_000 if batch["ts"].dtype.str.endswith("[ns]") else 1_000)
            kinds = batch[self.kind_column].to_numpy("int64") if self.kind_column in batch else np.zeros(len(batch), np.int64)
            run = Run(millis, batch["seq"].to_numpy("int64"), kinds, batch[self.payload].to_numpy("float64", na_value=np.nan))
            behind = run.ts <= self.answered(run)
            if self.at_once is not None:
                behind |= run.kind == self.at_once
            if behind.any():
                yield self._frame(self.late(tuple(key), run[behind].in_order(), timerValues.getCurrentWatermarkInMs()))
            if not behind.all():
                self.buffer.appendValue(run[~behind].packed())
                least = int(run.ts[~behind].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [tuple(p) for p in self.buffer.get()] if self.buffer.exists() else []
        if not parts:
            return
        passed = timerValues.getCurrentWatermarkInMs()
        run = Run.joined(parts, len(self.payload))
        due = run.ts <= passed
        if not due.any():
            return
        if due.all():
            self.buffer.clear()
        else:
            rest = run[~due]
            self.buffer.put([rest.packed()])
            self.handle.registerTimer(int(rest.ts.min()))
        self.passed.update((passed,))
        yield self._frame(self.advance(tuple(key), run[due].in_order(), passed))

    def close(self) -> None:
        pass


def run_ordered(
    stream: DataFrame, keys: Sequence[str], processor: OrderedProcessor, schema: str, *, delay: str, event_time: str = ""
) -> DataFrame:
    """The stream, with columns ts and seq, through a processor; its watermark trails the latest ts by ``delay``.

    ``event_time`` names the output column that an ordered step behind this one goes by.
    """
    ticks = F.explode(F.array(F.col("ts"), F.lit(None).cast("timestamp")))
    # The filter names the clock, so it stays behind the watermark node.
    data = stream.withColumn("_clock", ticks).withWatermark("_clock", delay).filter("_clock IS NULL")
    return _stateful(data, keys, processor, schema, event_time)


def run_behind(stream: DataFrame, keys: Sequence[str], processor: OrderedProcessor, schema: str) -> DataFrame:
    """A processor on the output of ``run_ordered(..., event_time="ts")``, in the same query."""
    return _stateful(stream, keys, processor, schema, "")


def _stateful(data: DataFrame, keys: Sequence[str], processor: OrderedProcessor, schema: str, event_time: str) -> DataFrame:
    return data.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName=event_time
    )


def finish(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run over everything available, write parquet, and read it back as a batch."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def with_flush(rows: DataFrame, keys: dict[str, object], seconds: int) -> DataFrame:
    """One marker row beyond the last event, so that a bounded run drains its tail."""
    last = rows.agg((F.max("ts") + F.make_interval(secs=F.lit(seconds))).alias("ts"))
    marks = last.select(
        *[
            (F.col("ts") if c == "ts" else F.lit(keys.get(c)).cast(t)).alias(c)
            for c, t in rows.dtypes
        ]
    )
    return rows.unionByName(marks)
