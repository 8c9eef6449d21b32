"""A calibrated predictor that is fitted once, saved, and applied to other domains later without refitting."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcal.functions.expressions import clip
from panelcal.operators import conformal, models
from panelcal.schema import ENTITY, ContractError, check_feature_columns, check_same_features
from panelcal.session import local_rows


@dataclass(frozen=True)
class FrozenConformal:
    """Models, conformal quantiles, feature names and label cap of one fit.

    ``quantiles`` has a row per model and alpha: (model, alpha, quantile, n_cal, requested_rank,
    finite_rank_attainable); an unattainable rank has an infinite quantile.
    """

    features: tuple[str, ...]
    cap: float
    models: tuple
    quantiles: tuple[tuple[str, float, float, int, int, bool], ...]

    def predict(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep, model, pred_raw, pred); ``rows`` must have exactly the features of the fit besides ``keep``."""
        check_same_features(self.features, [c for c in rows.columns if c not in keep or c in self.features])
        check_feature_columns(rows, self.features)
        found = models.predict_long(self.models, rows, [*keep])
        return found.withColumn("pred", clip("pred_raw", 0.0, F.lit(self.cap)))

    def apply(self, rows: DataFrame, keep: Sequence[str] = (ENTITY,)) -> DataFrame:
        """Intervals of every row for each model and alpha. Nothing is learned from ``rows``."""
        table = local_rows(
            rows.sparkSession,
            [(m, a, q if q != float("inf") else None, n, r, str(ok)) for m, a, q, n, r, ok in self.quantiles],
            "model string, alpha double, quantile double, n_cal bigint, requested_rank bigint, ok string",
        )
        cells = table.select(
            "model", "alpha", F.coalesce("quantile", F.lit(float("inf"))).alias("quantile"), "n_cal", "requested_rank", (F.col("ok") == "True").alias("finite_rank_attainable")
        )
        joined = self.predict(rows, keep).join(F.broadcast(cells), "model")
        return joined.withColumn("lower", F.col("pred") - F.col("quantile")).withColumn("upper", F.col("pred") + F.col("quantile"))

    def save(self, spark: SparkSession, path: str) -> None:
        """One text file for everything but tree models, which Spark writes beside it."""
        described = []
        for m in self.models:
            if isinstance(m, models.MeanModel):
                described.append({"name": m.name, "kind": "mean", "mean": m.mean})
            elif isinstance(m, models.RidgeModel):
                described.append({"name": m.name, "kind": "ridge", "weights": m.weights, "intercept": m.intercept, "scaling": m.scaling})
            else:
                m.model.write().save(f"{path}/{m.name}")
                described.append({"name": m.name, "kind": "columns"})
        state = {"features": self.features, "cap": self.cap, "models": described, "quantiles": [[*q[:2], str(q[2]), *q[3:]] for q in self.quantiles]}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FrozenConformal:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        loaded = []
        for d in state["models"]:
            if d["kind"] == "mean":
                loaded.append(models.MeanModel(d["mean"]))
            elif d["kind"] == "ridge":
                loaded.append(models.RidgeModel(d["weights"], d["intercept"], {k: tuple(v) for k, v in d["scaling"].items()}))
            else:
                loaded.append(models.ColumnsModel(d["name"], PipelineModel.load(f"{path}/{d['name']}")))
        quantiles = tuple((m, a, float(q), n, r, ok) for m, a, q, n, r, ok in state["quantiles"])
        return FrozenConformal(tuple(state["features"]), state["cap"], tuple(loaded), quantiles)


def freeze(
    fitted: Sequence,
    calibration: DataFrame,
    features: Sequence[str],
    *,
    cap: float,
    alphas: Sequence[float] = conformal.ALPHAS,
    policy: str = conformal.INFINITE,
    label: str = "rul_capped",
) -> FrozenConformal:
    """Calibrate fitted models on the calibration rows (one per entity, with features and label)."""
    if not fitted:
        raise ContractError("no fitted models")
    check_feature_columns(calibration, features)
    scores = models.predict_long(fitted, calibration, [label]).select(
        "model", F.abs(F.col(label).cast("double") - clip("pred_raw", 0.0, F.lit(float(cap)))).alias("score")
    )
    found = conformal.calibrate(scores, ["model"], alphas, policy=policy)
    # One row per model and alpha.
    rows = found.select("model", "alpha", "quantile", "n_cal", "requested_rank", "finite_rank_attainable").orderBy("model", "alpha").collect()
    return FrozenConformal(tuple(features), float(cap), tuple(fitted), tuple(tuple(r) for r in rows))
