"""Operating-regime scaling: cluster the settings, then standardise features within a regime."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.operators.weights import standardise
from panelcal.schema import SETTINGS, ContractError, check_feature_columns, check_same_features
from panelcal.session import cut, stored

MAX_REGIMES = 6  # fixed value: regimes are searched from 2 to 6
VECTORS_A_TASK = 20_000
SINGLE_SETTING, NO_CLUSTERING = "single_distinct_setting", "no_valid_clustering"


def regime_statistics(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population sd of every feature per regime, long. A zero sd divides by one."""
    wide = rows.groupBy("regime").agg(
        *[F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("sd")).alias(f) for f in features]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("s")) for f in features])
    return wide.select("regime", F.explode(pairs).alias("_p")).select(
        "regime",
        "_p.feature",
        F.col("_p.s.mean").alias("mean"),
        F.when(F.col("_p.s.sd") > 0, F.col("_p.s.sd")).otherwise(F.lit(1.0)).alias("sd"),
    )


def scale_by_regime(rows: DataFrame, statistics: dict[int, dict[str, tuple[float, float]]], features: Sequence[str]) -> DataFrame:
    """Standardise with the statistics of the row's regime (at most six, so literals)."""
    regimes = sorted(statistics)

    def scaled(name: str):
        out = None
        for r in regimes:
            m, s = statistics[r].get(name, (0.0, 1.0))
            value = (F.col(name) - F.lit(m)) / F.lit(s)
            out = F.when(F.col("regime") == r, value) if out is None else out.when(F.col("regime") == r, value)
        return out

    return rows.withColumns({f: scaled(f) for f in features})


def assign_nearest(rows: DataFrame, centres: Sequence[Sequence[float]], columns: Sequence[str]) -> DataFrame:
    """Nearest centre by squared Euclidean distance, the lower index on a tie."""
    distances = []
    for i, centre in enumerate(centres):
        parts = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre, strict=True)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        distances.append(F.struct(total.alias("d"), F.lit(i).alias("regime")))
    return rows.withColumn("regime", F.array_min(F.array(*distances))["regime"])


@dataclass
class RegimeScaler:
    """Fitted scaler: settings scaling, regime centres (none for the global fallback), statistics."""

    features: list[str]
    settings: list[str]
    setting_scaling: dict[str, tuple[float, float]]
    centres: list[list[float]]
    statistics: dict[int, dict[str, tuple[float, float]]]
    fallback_reason: str | None = None
    silhouettes: dict[int, float] = field(default_factory=dict)

    @property
    def n_regimes(self) -> int:
        return max(len(self.centres), 1)

    def assign(self, rows: DataFrame) -> DataFrame:
        if not self.centres:
            return rows.withColumn("regime", F.lit(0))
        z = rows.withColumns({f"_z{i}": (F.col(c) - m) / s for i, (c, (m, s)) in enumerate(self.setting_scaling.items())})
        names = [f"_z{i}" for i in range(len(self.settings))]
        return assign_nearest(z, self.centres, names).drop(*names)

    def transform(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        check_same_features([*self.features, *keep], rows.columns)
        return scale_by_regime(self.assign(rows), self.statistics, self.features)

    def to_text(self) -> str:
        """The fit as text that ``from_text`` reads back bit for bit."""
        return json.dumps(asdict(self))

    @staticmethod
    def from_text(text: str) -> RegimeScaler:
        held = json.loads(text)
        pairs = lambda table: {k: tuple(v) for k, v in table.items()}
        held["setting_scaling"] = pairs(held["setting_scaling"])
        held["statistics"] = {int(k): pairs(v) for k, v in held["statistics"].items()}
        held["silhouettes"] = {int(k): v for k, v in held["silhouettes"].items()}
        return RegimeScaler(**held)


def _statistics(rows: DataFrame, features: Sequence[str]) -> dict[int, dict[str, tuple[float, float]]]:
    out: dict[int, dict[str, tuple[float, float]]] = {}
    # At most six regimes times the feature list.
    for r in regime_statistics(rows, features).collect():
        out.setdefault(int(r.regime), {})[r.feature] = (float(r["mean"]), float(r.sd))
    return out


def choose_regimes(scores: dict[int, float]) -> int | None:
    """The k of the greatest silhouette, the smallest such k on a tie."""
    return max(sorted(scores), key=lambda k: scores[k]) if scores else None


def silhouette(labelled: DataFrame, columns: Sequence[str], weight: str) -> float:
    """Mean squared Euclidean silhouette of rows that each stand for ``weight`` equal ones, from sums per regime.

    Spark's evaluator leaves a row's whole weight out of its own cluster, so its weighted value is not that of the single rows.
    """
    square = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    # One row a regime.
    clusters = labelled.groupBy("regime").agg(
        F.sum(weight), F.sum(square * F.col(weight)), *[F.sum(F.col(c) * F.col(weight)) for c in columns]
    ).collect()
    others, own = [], F.lit(None).cast("double")
    for regime, n, norms, *sums in clusters:
        distance = square + F.lit(norms / n) - 2.0 * sum((F.col(c) * F.lit(v / n) for c, v in zip(columns, sums, strict=True)), F.lit(0.0))
        here = F.col("regime") == regime
        others.append(F.when(~here, distance))
        own = F.when(here, distance * F.lit(n / (n - 1)) if n > 1 else F.lit(float("nan"))).otherwise(own)
    value = (
        F.when(F.isnan("_a") | (F.col("_a") == F.col("_b")), 0.0)
        .when(F.col("_a") < F.col("_b"), 1.0 - F.col("_a") / F.col("_b"))
        .otherwise(F.col("_b") / F.col("_a") - 1.0)
    )
    rated = labelled.select(own.alias("_a"), F.least(*others).alias("_b"), weight)
    return float(rated.agg(F.sum(value * F.col(weight)) / F.sum(weight)).first()[0])


def fit_regime_scaler(
    rows: DataFrame,
    features: Sequence[str],
    *,
    settings: Sequence[str] = SETTINGS,
    n_regimes: int | None = None,
    seed: int = 13,
) -> RegimeScaler:
    """Search k = 2..6 by silhouette on standardised settings, then per-regime statistics.

    Falls back to one global regime when the settings take a single value or no k gives k
    non-empty clusters. Training rows only.
    """
    check_feature_columns(rows, features)
    settings, features = list(settings), list(features)
    scaled, setting_scaling = standardise(rows.select(*settings), settings)
    sizes = rows.agg(
        F.count(F.lit(1)).alias("n"),
        # Only whether there are fewer distinct settings than regimes matters.
        F.count_distinct(F.struct(*settings)).alias("distinct"),
    ).first()
    if sizes.distinct < 2:
        return RegimeScaler(features, settings, setting_scaling, [], _statistics(rows.withColumn("regime", F.lit(0)), features), SINGLE_SETTING)
    if sizes.n < 3:
        raise ContractError("at least 3 training rows are required")
    top = min(MAX_REGIMES, sizes.n - 1)
    if n_regimes is not None and not 2 <= n_regimes <= top:
        raise ContractError("n_regimes must lie between 2 and the number of training rows minus one")
    # Equal settings are one vector with their number as weight: that is the same objective, and settings of a few values take the
    # passes of every k over a few rows. In their order, so that the fit does not follow the order in which files are read.
    counted = scaled.groupBy(*settings).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    assembler = VectorAssembler(inputCols=settings, outputCol="_x")
    vectors = stored(assembler.transform(counted).select("_x", "_w", *settings), "regime-settings")
    slices = max(1, math.ceil(sizes.distinct / VECTORS_A_TASK))
    vectors = cut(vectors.repartitionByRange(slices, *settings).sortWithinPartitions(*settings))
    models: dict[int, KMeansModel] = {}
    scores: dict[int, float] = {}
    for k in [n_regimes] if n_regimes else range(2, top + 1):
        if k > sizes.distinct:
            continue
        model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="regime", weightCol="_w").fit(vectors)
        labelled = model.transform(vectors)
        if labelled.agg(F.count_distinct("regime")).first()[0] != k:
            continue
        models[k], scores[k] = model, silhouette(labelled, settings, "_w")
    chosen = choose_regimes(scores)
    if chosen is None:
        return RegimeScaler(features, settings, setting_scaling, [], _statistics(rows.withColumn("regime", F.lit(0)), features), NO_CLUSTERING)
    centres = [[float(v) for v in c] for c in models[chosen].clusterCenters()]
    fitted = RegimeScaler(features, settings, setting_scaling, centres, {}, None, scores)
    fitted.statistics = _statistics(fitted.assign(rows), features)
    return fitted


class _RegimeParams(Params):
    featureCols = Param(Params._dummy(), "featureCols", "columns to scale", TypeConverters.toListString)
    settingCols = Param(Params._dummy(), "settingCols", "operating settings", TypeConverters.toListString)
    keepCols = Param(Params._dummy(), "keepCols", "columns that are carried along", TypeConverters.toListString)
    nRegimes = Param(Params._dummy(), "nRegimes", "number of regimes, 0 to search", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the clustering", TypeConverters.toInt)
    fitted = Param(Params._dummy(), "fitted", "centres and statistics of the fit", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(settingCols=list(SETTINGS), keepCols=[], nRegimes=0, seed=13)


class RegimeScaling(Estimator, _RegimeParams, DefaultParamsReadable, DefaultParamsWritable):
    """``fit_regime_scaler`` as an estimator, so that the scaler has its place in a pipeline and on disk."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._defaults()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> RegimeScalingModel:
        get = self.getOrDefault
        scaler = fit_regime_scaler(dataset, get("featureCols"), settings=get("settingCols"), n_regimes=get("nRegimes") or None, seed=get("seed"))
        model = RegimeScalingModel()
        self._copyValues(model)
        model._set(fitted=scaler.to_text())
        return model


class RegimeScalingModel(Model, _RegimeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Scales with the centres and statistics of the fit, which are written and read with it."""

    def __init__(self) -> None:
        super().__init__()
        self._defaults()

    @property
    def scaler(self) -> RegimeScaler:
        return RegimeScaler.from_text(self.getOrDefault("fitted"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.scaler.transform(dataset, [*self.getOrDefault("keepCols"), *[c for c in self.getOrDefault("settingCols") if c not in self.getOrDefault("featureCols")]])
