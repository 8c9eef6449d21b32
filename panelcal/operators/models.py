"""Point and quantile models. Fits are Spark ML jobs; predictions are long rows (model, pred_raw)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcal.functions.expressions import is_finite
from panelcal.operators.weights import standardise
from panelcal.schema import ContractError, require

# Fixed values of the model protocol.
POINT_MODELS = ("mean", "ridge", "hist_gradient_boosting")
RIDGE_ALPHA = 1.0


def checked_training(rows: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Training rows; a missing or infinite label or feature fails the job that reads them."""
    require(rows, [*features, label, *keep])

    def finite(name: str, what: str) -> Column:
        return F.when(is_finite(name), F.col(name).cast("double")).otherwise(F.raise_error(F.lit(f"{what} must be finite")))

    return rows.select(*[finite(f, "features").alias(f) for f in features], finite(label, "labels").alias("label"), *keep)


class MeanModel:
    """Predicts the training mean of the label."""

    name = "mean"

    def __init__(self, mean: float) -> None:
        self.mean = mean

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("pred_raw", F.lit(self.mean))


class ColumnsModel:
    """A Spark ML pipeline model behind the same ``predict`` surface; keeps the input columns."""

    def __init__(self, name: str, model: Model) -> None:
        self.name, self.model = name, model

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).select(*rows.columns, F.col("prediction").alias("pred_raw"))


class RidgeModel:
    """Linear predictor on standardised features as one expression."""

    name = "ridge"

    def __init__(self, weights: dict[str, float], intercept: float, scaling: dict[str, tuple[float, float]]) -> None:
        self.weights, self.intercept, self.scaling = weights, intercept, scaling

    def predict(self, rows: DataFrame) -> DataFrame:
        terms = F.array(*[(F.col(f) - self.scaling[f][0]) / self.scaling[f][1] * w for f, w in self.weights.items()])
        total = F.aggregate(terms, F.lit(self.intercept), lambda acc, x: acc + x)
        return rows.withColumn("pred_raw", total)


def fit_mean(rows: DataFrame, label: str = "rul_capped") -> MeanModel:
    mean = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if mean is None:
        raise ContractError("no training rows")
    return MeanModel(float(mean))


def fit_ridge(rows: DataFrame, features: Sequence[str], label: str = "rul_capped", *, alpha: float = RIDGE_ALPHA) -> RidgeModel:
    """Ridge on standardised columns, intercept free, by one pass over the normal equations.

    Spark scales the label by its population deviation inside this solver and averages the
    loss, so the penalty alpha becomes alpha / n times that deviation.
    """
    train = checked_training(rows, features, label)
    scaled, scaling = standardise(train, features)
    stats = train.agg(F.count(F.lit(1)), F.stddev_pop("label"), F.avg("label")).first()
    n, spread, mean = int(stats[0]), float(stats[1] or 0.0), float(stats[2])
    if spread == 0.0:
        return RidgeModel(dict.fromkeys(features, 0.0), mean, scaling)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    fit = LinearRegression(
        featuresCol="_x", labelCol="label", solver="normal", standardization=False, regParam=alpha / n * spread
    ).fit(assembler.transform(scaled).select("_x", "label"))
    return RidgeModel(dict(zip(features, map(float, fit.coefficients), strict=True)), float(fit.intercept), scaling)


def fit_boosting(
    rows: DataFrame,
    features: Sequence[str],
    label: str = "rul_capped",
    *,
    iterations: int = 50,
    step: float = 0.05,
    depth: int = 5,
    bins: int = 64,
    min_rows: int = 20,
    seed: int = 0,
    holdout: str | None = None,
) -> ColumnsModel:
    """Gradient boosted trees with squared loss. ``holdout`` names a boolean column that marks the
    rows of held-out entities for early stopping."""
    train = checked_training(rows, features, label, [holdout] if holdout else [])
    trees = GBTRegressor(
        featuresCol="_x",
        labelCol="label",
        maxIter=iterations,
        stepSize=step,
        maxDepth=depth,
        maxBins=bins,
        minInstancesPerNode=min_rows,
        seed=seed,
    )
    if holdout:
        trees = trees.setValidationIndicatorCol(holdout)
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), trees]
    return ColumnsModel("hist_gradient_boosting", Pipeline(stages=stages).fit(train))


def fit_point_models(
    rows: DataFrame, features: Sequence[str], label: str = "rul_capped", *, boosting: dict | None = None
) -> list:
    """The three point models on the same partition, in protocol order."""
    return [
        fit_mean(rows, label),
        fit_ridge(rows, features, label),
        fit_boosting(rows, features, label, **(boosting or {})),
    ]


def predict_long(models: Sequence, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per input row and model, from one pass over the rows, which may be a stream; the inputs are not changed."""
    out = rows
    for i, m in enumerate(models):
        out = m.predict(out).withColumnRenamed("pred_raw", f"_pred_{i}")
    found = F.explode(F.array(*[F.struct(F.lit(m.name).alias("model"), F.col(f"_pred_{i}").alias("pred_raw")) for i, m in enumerate(models)]))
    return out.select(*keep, found.alias("_m")).select(*keep, "_m.model", "_m.pred_raw")


class LeafQuantiles:
    """Quantile forest: label quantiles per leaf, averaged over trees.

    All quantiles of a leaf come from the same label counts, so a lower one never exceeds a
    higher one.
    """

    def __init__(self, model: Model, table: DataFrame, probabilities: Sequence[float]) -> None:
        self.model, self.table, self.probabilities = model, table, list(probabilities)

    def _leaves(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(rows)
        return scored.select(*rows.columns, F.posexplode(vector_to_array("_leaves")).alias("tree", "leaf"))

    def predict(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Rows (keys, quantiles array); ``keys`` identify a row."""
        # The table has trees x leaves rows, bounded by the depth of the forest.
        hits = self._leaves(rows).select(*keys, "tree", "leaf").join(F.broadcast(self.table), ["tree", "leaf"])
        means = [F.avg(F.col("quantiles")[i]) for i in range(len(self.probabilities))]
        return hits.groupBy(*keys).agg(F.array(*means).alias("quantiles"))


def leaf_table(rows: DataFrame, probabilities: Sequence[float], label: str = "label") -> DataFrame:
    """Quantiles of the label per (tree, leaf), from label counts (capped labels take few values)."""
    counts = rows.groupBy("tree", "leaf", label).agg(F.count(F.lit(1)).alias("_c"))
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    return counts.groupBy("tree", "leaf").agg(F.percentile(label, wanted, F.col("_c")).alias("quantiles"))


def fit_leaf_quantiles(
    rows: DataFrame,
    features: Sequence[str],
    probabilities: Sequence[float],
    label: str = "rul_capped",
    *,
    trees: int = 20,
    depth: int = 5,
    min_rows: int = 20,
    seed: int = 0,
) -> LeafQuantiles:
    train = checked_training(rows, features, label)
    forest = RandomForestRegressor(
        featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, seed=seed, leafCol="_leaves"
    )
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), forest]).fit(train)
    fitted = LeafQuantiles(model, train, probabilities)
    # Written once: every prediction reads it, and the forest must not be applied to the training rows again.
    from panelcal.session import stored

    fitted.table = stored(leaf_table(fitted._leaves(train), probabilities), "leaf-quantiles")
    return fitted
