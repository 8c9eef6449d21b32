"""Past-only window features.

A feature row depends on its own and earlier rows of the entity only, so the features of a
prefix are the prefix of the features: one pass serves every seed, cut and condition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcal.schema import CYCLE, ENTITY, SENSORS, SETTINGS, ContractError, check_same_features, require
from panelcal.session import cut

WINDOWS = (5, 10, 20)  # fixed values of the feature contract
CHUNK_CYCLES = 1 << 16
BROADCAST_ENTITIES = 1_000_000


def sensor_variances(panel: DataFrame, sensors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Population variance, minimum and maximum of every sensor, long, in one aggregate."""
    stats = panel.groupBy(*by).agg(
        *[F.struct(F.var_pop(s).alias("variance"), F.min(s).alias("low"), F.max(s).alias("high")).alias(s) for s in sensors]
    )
    pairs = F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(s).alias("v")) for s in sensors])
    return stats.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.sensor", "_p.v.*")


def kept_sensors(variances: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Sensors with variance above the threshold that really take two values.

    The second test keeps rounding in the variance from reviving a constant sensor.
    """
    return variances.withColumn("keep", (F.col("variance") > threshold) & (F.col("low") != F.col("high")))


def feature_names(sensors: Sequence[str], settings: Sequence[str] = SETTINGS, windows: Sequence[int] = WINDOWS) -> list[str]:
    """Model inputs in output order (the keys are not among them, the cycle index is)."""
    derived = [
        name
        for s in sensors
        for name in (f"{s}_delta_1", *[f"{s}_rolling_{stat}_{w}" for w in windows for stat in ("mean", "std", "slope")])
    ]
    return [*settings, *sensors, *derived, "cycle_index"]


def window_columns(values: np.ndarray, known: np.ndarray, position: np.ndarray, windows: Sequence[int]) -> list[np.ndarray]:
    """Delta, then mean, population std and slope of each window, as masked (rows x sensors) arrays.

    ``position`` counts the rows of an entity from 0, one for each of the last rows of ``values``; before them lie at least the
    max(windows) - 1 rows that their windows may reach back to. Rows that are not ``known`` (null) take no part.
    """
    depth = len(values) - len(position)
    paired = known[depth:] & known[depth - 1 : -1] & (position > 0)[:, None]
    out = [np.where(paired, values[depth:] - values[depth - 1 : -1], 0.0)]
    # By distance back: whether there is a value, and the value or zero. Whole columns are added, never short rows.
    held = [(known[depth - k : len(values) - k] & (position >= k)[:, None]).astype(np.float64) for k in range(max(windows))]
    x = [np.where(h > 0, values[depth - k : len(values) - k], 0.0) for k, h in enumerate(held)]
    for w in windows:
        count = sum(held[:w])
        some = np.maximum(count, 1.0)
        mean, middle = sum(x[:w]) / some, sum(h * -k for k, h in enumerate(held[:w])) / some
        square, below, slope = np.zeros_like(mean), np.zeros_like(mean), np.zeros_like(mean)
        for k in range(w):
            off, spread = (x[k] - mean) * held[k], (-k - middle) * held[k]
            square += off * off
            below += spread * spread
            slope += off * spread
        out += [np.ma.array(mean, mask=count == 0), np.sqrt(square / some), slope / np.where(below > 0, below, 1.0)]
    return out


def _with_windows(ordered: DataFrame, sensors: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Adds the derived columns to rows that lie by entity and cycle in their partition, with their ``_pos``.

    A Spark window frame adds up all its rows anew for each row and statistic; here a batch of rows is one array, and a task
    carries the last max(windows) - 1 rows from batch to batch.
    """
    derived = feature_names(sensors, [], windows)[len(sensors) : -1]
    schema = T.StructType([*ordered.schema.fields, *[T.StructField(n, T.DoubleType()) for n in derived]])
    width, depth = len(sensors), max(windows) - 1
    numbers = [f"_x{i}" for i in range(width)]
    given = ordered.withColumns({n: F.col(f"`{s}`").cast("double") for n, s in zip(numbers, sensors, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, known = np.zeros((depth, width)), np.zeros((depth, width), bool)
        for batch in batches:
            x = [batch.column(n) for n in numbers]
            values = np.concatenate([values[len(values) - depth :], np.column_stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in x])])
            known = np.concatenate([known[len(known) - depth :], np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in x])])
            made = window_columns(values, known, batch.column("_pos").to_numpy(), windows)
            columns = [pa.array(np.ma.getdata(m)[:, i], mask=np.ma.getmaskarray(m)[:, i]) for i in range(width) for m in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - width], *columns], names=schema.names)

    return given.mapInArrow(run, schema)


def _halo(panel: DataFrame, by: list[str], chunk: Column, depth: int, long_entities: DataFrame) -> DataFrame:
    """Rows each chunk of a long entity needs from its neighbours.

    The last ``depth`` rows before the chunk (from as many earlier chunks as it takes) and the
    first row after it. Only long entities are read, and per entity the window sees a few
    rows per chunk.
    """
    rest = [c for c in panel.columns if c not in by]
    record = F.struct(CYCLE, *[c for c in rest if c != CYCLE])
    rows = panel.join(long_entities, by, "left_semi").withColumn("_chunk", chunk)
    inside = Window.partitionBy(*by, "_chunk")
    near = (
        rows.withColumn("_back", F.row_number().over(inside.orderBy(F.desc(CYCLE))))
        .withColumn("_first", F.min(CYCLE).over(inside))
        .filter((F.col("_back") <= depth) | (F.col(CYCLE) == F.col("_first")))
    )
    ends = near.groupBy(*by, "_chunk").agg(
        F.sort_array(F.collect_list(F.when(F.col("_back") <= depth, record))).alias("_tail"),
        F.max(F.when(F.col(CYCLE) == F.col("_first"), record)).alias("_head"),
    )
    along = Window.partitionBy(*by).orderBy("_chunk")
    earlier = F.flatten(F.collect_list("_tail").over(along.rowsBetween(-depth, -1)))
    keep = F.slice(earlier, -F.least(F.lit(depth), F.size(earlier)), F.least(F.lit(depth), F.size(earlier)))
    before = F.when(F.size(earlier) > 0, keep).otherwise(F.slice(earlier, 1, 0))
    following = F.lead("_head").over(along)
    copies = ends.select(*by, "_chunk", before.alias("_before"), following.alias("_next"))
    exploded = copies.select(
        *by,
        "_chunk",
        F.explode(F.concat("_before", F.when(F.col("_next").isNotNull(), F.array("_next")).otherwise(F.slice("_before", 1, 0)))).alias("_r"),
    )
    return exploded.select(*by, "_r.*", "_chunk", F.lit(True).alias("_copy")).select(*by, *rest, "_chunk", "_copy")


def temporal_features(
    panel: DataFrame,
    sensors: Sequence[str],
    *,
    settings: Sequence[str] = SETTINGS,
    windows: Sequence[int] = WINDOWS,
    by: Sequence[str] = (ENTITY,),
    carry: Sequence[str] = (),
    chunk_cycles: int = CHUNK_CYCLES,
    with_next: bool = False,
) -> DataFrame:
    """Per sensor: delta to the previous row, and mean, population std and slope against the
    row position over the last ``w`` rows (fewer at the start).

    One exchange and one sort on (entity, chunk, cycle) serve positions and windows; null values take no part. An entity that
    runs beyond ``chunk_cycles`` is cut into chunks that carry copies of the rows their frames
    reach back to, so no task holds one whole long entity. Panels without such an entity, as a
    one-column maximum shows, get the plain plan. ``with_next`` adds ``next_cycle``.
    """
    by = list(by)
    if not windows or any(w < 2 for w in windows):
        raise ContractError("windows must be at least 2 rows")
    require(panel, [*by, CYCLE, *settings, *sensors, *carry])
    base = panel.select(*by, CYCLE, *settings, *sensors, *carry)
    chunk = F.floor((F.col(CYCLE) - 1) / chunk_cycles)
    top = base.agg(F.max(CYCLE)).first()[0]
    keys = by
    if top is not None and top > chunk_cycles:
        lives = base.groupBy(*by).agg(F.max(CYCLE).alias("_last"))
        long_entities = cut(lives.filter(F.col("_last") > chunk_cycles).select(*by))
        if long_entities.count() <= BROADCAST_ENTITIES:
            long_entities = F.broadcast(long_entities)
        copies = _halo(base, by, chunk, max(max(windows) - 1, 1), long_entities)
        base = base.withColumn("_chunk", chunk).withColumn("_copy", F.lit(False)).unionByName(copies)
        keys = [*by, "_chunk"]
    ordered = Window.partitionBy(*keys).orderBy(CYCLE)
    positioned = base.withColumn("_pos", F.row_number().over(ordered) - 1)
    if with_next:
        positioned = positioned.withColumn("next_cycle", F.lead(CYCLE).over(ordered))
    if sensors:
        # The order is that of the windows, so Spark sorts once.
        positioned = _with_windows(positioned.sortWithinPartitions(*keys, CYCLE), sensors, windows)
    if "_copy" in base.columns:
        positioned = positioned.filter(~F.col("_copy"))
    extra = ["next_cycle"] if with_next else []
    derived = feature_names(sensors, [], windows)[len(sensors) : -1]
    return positioned.select(*by, CYCLE, *settings, *sensors, *derived, F.col(CYCLE).cast("double").alias("cycle_index"), *carry, *extra)


class _FeatureParams(Params):
    entityCols = Param(Params._dummy(), "entityCols", "key columns of an entity", TypeConverters.toListString)
    settingCols = Param(Params._dummy(), "settingCols", "operating settings", TypeConverters.toListString)
    sensorCols = Param(Params._dummy(), "sensorCols", "candidate sensors", TypeConverters.toListString)
    windows = Param(Params._dummy(), "windows", "rolling window lengths", TypeConverters.toListInt)
    threshold = Param(Params._dummy(), "threshold", "variance a sensor must exceed", TypeConverters.toFloat)
    chunkCycles = Param(Params._dummy(), "chunkCycles", "cycles per chunk of a long entity", TypeConverters.toInt)
    keptSensors = Param(Params._dummy(), "keptSensors", "sensors that passed the fit", TypeConverters.toListString)

    def _defaults(self) -> None:
        self._setDefault(
            entityCols=[ENTITY],
            settingCols=list(SETTINGS),
            sensorCols=list(SENSORS),
            windows=list(WINDOWS),
            threshold=0.0,
            chunkCycles=CHUNK_CYCLES,
        )


class TemporalFeatures(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Chooses the sensors that vary over the training rows."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._defaults()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> TemporalFeaturesModel:
        sensors = self.getOrDefault("sensorCols")
        require(dataset, [*self.getOrDefault("entityCols"), CYCLE, *self.getOrDefault("settingCols"), *sensors])
        table = kept_sensors(sensor_variances(dataset, sensors), self.getOrDefault("threshold"))
        varying = {r.sensor for r in table.filter("keep").collect()}
        if not varying:
            raise ContractError("no sensor varies over the training rows")
        model = TemporalFeaturesModel()
        self._copyValues(model)
        model._set(keptSensors=[s for s in sensors if s in varying])
        return model


class TemporalFeaturesModel(Model, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self) -> None:
        super().__init__()
        self._defaults()

    @property
    def features(self) -> list[str]:
        get = self.getOrDefault
        return feature_names(get("keptSensors"), get("settingCols"), get("windows"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        fitted = [*get("entityCols"), CYCLE, *get("settingCols"), *get("sensorCols")]
        check_same_features(fitted, dataset.columns)
        return temporal_features(
            dataset,
            get("keptSensors"),
            settings=get("settingCols"),
            windows=get("windows"),
            by=get("entityCols"),
            chunk_cycles=get("chunkCycles"),
        )
