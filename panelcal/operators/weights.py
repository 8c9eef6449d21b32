"""Density-ratio weights between calibration and target endpoints from operating settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.functions.expressions import density_odds
from panelcal.schema import SETTINGS, ContractError, require

# Fixed values of the weighting protocol.
LOGISTIC_C, MAX_ITERATIONS, CLIP_MIN, CLIP_MAX = 1.0, 1000, 0.1, 10.0


def standardise(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Centre and divide by the population standard deviation (a constant column by 1)."""
    stats = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    fitted = {c: (float(stats[f"m_{c}"]), float(stats[f"s_{c}"]) or 1.0) for c in columns}
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in fitted.items()}), fitted


def density_ratios(
    source: DataFrame, target: DataFrame, features: Sequence[str] = SETTINGS, *, c: float = LOGISTIC_C
) -> tuple[DataFrame, DataFrame, dict]:
    """Logistic source/target classifier on standardised settings, turned into density ratios.

    Returns both sides with a ``ratio`` column, and the fit as a plain dict. The penalty is
    0.5 |w|^2 against C times the summed loss, hence regParam = 1 / (C n).
    """
    require(source, features)
    require(target, features)
    if c <= 0:
        raise ContractError("the inverse penalty must be positive")
    union = (
        source.select(*features)
        .withColumn("label", F.lit(0.0))
        .unionByName(target.select(*features).withColumn("label", F.lit(1.0)))
    )
    scaled, fitted = standardise(union, features)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    counts = {r["label"]: r["count"] for r in scaled.groupBy("label").count().collect()}
    n_source, n_target = counts.get(0.0, 0), counts.get(1.0, 0)
    if not n_source or not n_target:
        raise ContractError("both sides of the density ratio need rows")
    model = LogisticRegression(
        featuresCol="_x",
        labelCol="label",
        maxIter=MAX_ITERATIONS,
        tol=1e-10,
        regParam=1.0 / (c * (n_source + n_target)),
        standardization=False,
    ).fit(assembler.transform(scaled).select("_x", "label"))

    coefficients, intercept = [float(v) for v in model.coefficients], float(model.intercept)

    def rated(rows: DataFrame) -> DataFrame:
        """An expression, not the model's own transform: that ships the training summary and with it the session, which tags and observations make unserialisable."""
        terms = F.array(*[(F.col(f) - m) / s * w for (f, (m, s)), w in zip(fitted.items(), coefficients, strict=True)])
        margin = F.aggregate(terms, F.lit(0.0), lambda total, x: total + x) + intercept
        ratio = density_odds(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)), F.lit(n_source), F.lit(n_target))
        return rows.select("*", ratio.alias("ratio"))

    details = {
        "features": list(features),
        "coefficients": coefficients,
        "intercept": intercept,
        "source_count": n_source,
        "target_count": n_target,
        "scaling": fitted,
    }
    return rated(source), rated(target), details
