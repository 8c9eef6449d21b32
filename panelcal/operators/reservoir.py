"""Exact audit of a calibration quantile drawn from a finite reservoir.

The quantile of a uniform n-subset of N scores is the r-th smallest of the subset. Its rank in
the reservoir has P(k) = C(k-1, r-1) C(N-k, n-r) / C(N, n), so coverage, width and score have
exact distributions, compared here with Beta and beta-binomial references. Cells are rows; all
cells of all reservoirs go through one plan.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcal.functions.beta import (
    beta_cdf,
    beta_cdf_integral,
    beta_mean,
    beta_quantile,
    beta_sd,
    ln_beta,
    ln_choose,
)
from panelcal.functions.expressions import cell_key, rank_regime, requested_rank, severe_threshold
from panelcal.operators.ranks import count_and_sum_up_to, distributed_rank, running_totals
from panelcal.schema import ENTITY, ContractError
from panelcal.session import local_rows, stored

EVALUATED = "evaluate"
EXCLUDED_UNATTAINABLE = "excluded_unattainable"
EXCLUDED_DEGENERATE = "excluded_degenerate"
#: Exact counts have up to so many digits: those of reservoirs of some ten thousand scores.
MAX_DIGITS = 3000
#: Digits of a limb; sums of limbs of 10^20 rows fit DECIMAL(38, 0).
LIMB = 15
EXACT, BEYOND_DIGITS = "exact", "beyond_digits"
ENDPOINTS = 100  # fixed value: evaluation endpoints of the beta-binomial reference
CELL_SCHEMA = "role string, n_cal bigint, alpha double"


def declared_cells(spark: SparkSession, cells: Sequence[tuple[str, int, float]]) -> DataFrame:
    """Declared (role, n_cal, alpha) rows."""
    if any(n < 1 or not 0 < a < 1 for _, n, a in cells):
        raise ContractError("an audit cell needs n_cal >= 1 and alpha strictly between 0 and 1")
    return local_rows(spark, [(r, int(n), float(a)) for r, n, a in cells], CELL_SCHEMA)


def cell_grid(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rank, regime, support and subset count per cell and reservoir.

    ``sizes`` holds the reservoir keys and ``reservoir_size``. Cells without a distribution
    stay as rows with their status.
    """
    n, size = F.col("n_cal"), F.col("reservoir_size")
    rank = requested_rank("n_cal", "alpha")
    evaluated = F.col("status") == EVALUATED
    status = (
        F.when(rank > n, EXCLUDED_UNATTAINABLE).when(n >= size, EXCLUDED_DEGENERATE).otherwise(EVALUATED)
    )
    grid = (
        sizes.crossJoin(F.broadcast(cells))
        .withColumn("cell_id", cell_key("n_cal", "alpha"))
        .withColumn("requested_rank", rank)
        .withColumn("status", status)
        .withColumn("finite_rank_attainable", F.col("requested_rank") <= n)
        .withColumn("regime", rank_regime("requested_rank", "n_cal"))
        .withColumn("support_position_min", F.when(evaluated, F.col("requested_rank")))
        .withColumn("support_position_max", F.when(evaluated, size - n + F.col("requested_rank")))
        .withColumn("finite_population_factor", (size - n) / (size - F.lit(1)))
    )
    count = F.when(evaluated, exact_choose("reservoir_size", "n_cal"))
    return grid.withColumn("combination_count", count).withColumn(
        "combination_status", F.when(evaluated, F.when(F.col("combination_count").isNull(), BEYOND_DIGITS).otherwise(EXACT))
    )


def log10_choose(m: int, k: int) -> float:
    return (math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)) / math.log(10)


@F.pandas_udf(T.StringType())
def exact_choose(m: pd.Series, k: pd.Series) -> pd.Series:
    """C(m, k) as decimal text; null where it has more than ``MAX_DIGITS`` digits, which its logarithm tells before it is made."""
    sys.set_int_max_str_digits(0)

    def choose(m: int, k: int) -> str | None:
        if not 0 <= k <= m:
            return "0"
        return str(math.comb(m, k)) if log10_choose(m, k) <= MAX_DIGITS else None

    return pd.Series([None if pd.isna(a) or pd.isna(b) else choose(int(a), int(b)) for a, b in zip(m, k, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("limbs", T.ArrayType(T.LongType())), T.StructField("probability", T.DoubleType())]))
def exact_mass(position: pd.Series, rank: pd.Series, n: pd.Series, size: pd.Series) -> pd.DataFrame:
    """C(position - 1, rank - 1) C(size - position, n - rank) in limbs of ``LIMB`` digits, least first, and its exact share of C(size, n).

    Along a cell's positions each number follows from the one before by one product and one exact division, so a batch
    makes few of them anew. Null where the subset count has more than ``MAX_DIGITS`` digits.
    """
    limbs: list[list[int] | None] = [None] * len(position)
    shares = np.full(len(position), np.nan)
    columns = [c.to_numpy("int64") for c in (size, n, rank, position)]
    cell, count, last, value = None, 0, 0, 0
    base = 10**LIMB
    for i in np.lexsort(columns[::-1]):
        z, m, r, k = (int(c[i]) for c in columns)
        if (z, m, r) != cell:
            cell, last = (z, m, r), 0
            count = math.comb(z, m) if log10_choose(z, m) <= MAX_DIGITS else 0
        if not count:
            continue
        if last and k == last + 1:
            value = value * (k - 1) * (z - k + 1 - m + r) // ((k - r) * (z - k + 1))
        else:
            value = math.comb(k - 1, r - 1) * math.comb(z - k, m - r)
        last = k
        shares[i] = value / count
        parts, rest = [], value
        while rest:
            rest, low = divmod(rest, base)
            parts.append(low)
        limbs[i] = parts or [0]
    return pd.DataFrame({"limbs": limbs, "probability": shares})


@F.pandas_udf(T.StringType())
def whole_text(limbs: pd.Series) -> pd.Series:
    """Decimal text of numbers in limbs, each of which may be a sum beyond its base."""
    sys.set_int_max_str_digits(0)
    return pd.Series([None if x is None else str(sum(int(v) * 10 ** (LIMB * i) for i, v in enumerate(x))) for x in limbs], dtype=object)


def position_masses(positions: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probability and multiplicity (``limbs``) of every support position; both are exact where the number of subsets has up to ``MAX_DIGITS`` digits.

    ``positions`` holds the reservoir keys and ``position``; its rows meet the declared cells by
    broadcast, so the work is spread like the reservoir itself.
    """
    r, n, size, k = (F.col(c) for c in ("requested_rank", "n_cal", "reservoir_size", "position"))
    cells = [*keys, "cell_id"]
    evaluated = grid.filter(F.col("status") == EVALUATED)
    joined = positions.join(evaluated, list(keys)) if keys else positions.crossJoin(F.broadcast(evaluated))
    held = joined.filter(k.between(F.col("support_position_min"), F.col("support_position_max")))
    exact = F.col("combination_count").isNotNull()
    # Beyond that many digits: logarithms, and normalising by the sum removes the common rounding of large factorials.
    logged = held.withColumn("_l", F.when(~exact, ln_choose(k - 1, r - 1) + ln_choose(size - k, n - r)))
    peak = logged.groupBy(*cells).agg(F.max("_l").alias("_peak"))
    raw = logged.join(peak, cells).withColumn("_w", F.exp(F.col("_l") - F.col("_peak")))
    mass = raw.groupBy(*cells).agg(F.sum("_w").alias("_sum"))
    out = raw.join(mass, cells).withColumn("_e", exact_mass(k, r, n, size))
    probability = F.when(exact, F.col("_e.probability")).otherwise(F.col("_w") / F.col("_sum"))
    return out.select(*joined.columns, F.when(exact, F.col("_e.limbs")).alias("limbs"), probability.alias("probability"))


def quantile_distribution(
    reservoir: DataFrame,
    grid: DataFrame,
    keys: Sequence[str],
    *,
    score: str = "score",
    tie: Sequence[str] = (ENTITY,),
    slices: int | None = None,
) -> DataFrame:
    """Distribution of the calibration quantile; equal doubles merge, one ulp apart stays apart.

    ``multiplicity`` and ``combination_count`` are decimal text, exact up to ``MAX_DIGITS`` digits (a reservoir of some ten thousand scores) and
    null beyond; ``position_multiplicities`` lists the multiplicity of each position. Multiplicities of equal scores are
    summed limb by limb, so they combine before the shuffle.
    """
    keys = list(keys)
    values = reservoir.select(*keys, *tie, F.col(score).cast("double").alias("quantile"))
    positions = distributed_rank(values, keys, "quantile", tie, out="position", slices=slices).drop(*tie)
    masses = stored(position_masses(positions, grid, keys), "position-masses")
    group = [*keys, "cell_id", "role", "n_cal", "alpha", "quantile"]
    found = masses.groupBy(*group).agg(
        F.min("position").alias("position_min"),
        F.max("position").alias("position_max"),
        F.max("combination_count").alias("combination_count"),
        F.sum("probability").alias("probability"),
    )
    each = masses.where("limbs is not null").select(*group, F.posexplode("limbs").alias("_i", "_v"))
    sums = each.groupBy(*group, "_i").agg(F.sum(F.col("_v").cast("decimal(38,0)")).cast("decimal(38,0)").alias("_v"))
    whole = sums.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_limbs"))
    # Positions without a number in exact limbs have no list.
    entry = F.struct(F.col("position").cast("string").alias("p"), whole_text("limbs").alias("t"))
    listed = masses.where("limbs is not null").select(*group, entry.alias("e")).groupBy(*group).agg(F.array_sort(F.collect_list("e")).alias("e"))
    # Numbers of any length, so the text of the list is put together here.
    members = F.transform("e", lambda x: F.concat(F.lit('"'), x["p"], F.lit('":'), x["t"]))
    texts = listed.select(*group, F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("position_multiplicities"))
    summed = whole.select(*group, whole_text("_limbs").alias("multiplicity"))
    joined = found.join(summed, group, "left").join(texts, group, "left")
    return joined.select(*group, "position_min", "position_max", F.coalesce("position_multiplicities", F.lit("{}")).alias("position_multiplicities"), "multiplicity", "combination_count", "probability")


def quantile_outcomes(
    quantiles: DataFrame, evaluation: DataFrame, keys: Sequence[str], *, scale: float, score: str = "score", slices: int | None = None
) -> DataFrame:
    """Coverage, width, normalised score and severe flag of each possible quantile.

    Coverage is the share of evaluation scores at or below the quantile. Running counts and
    sums over the union of both sides replace the pairwise comparison.
    """
    keys = list(keys)
    scores = evaluation.select(*keys, F.col(score).cast("double").alias("quantile"))
    upto = count_and_sum_up_to(quantiles.select(*keys, "quantile"), scores, keys, "quantile", slices=slices)
    totals = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.sum("quantile").alias("_s"))
    joined = quantiles.join(upto, [*keys, "quantile"])
    joined = joined.join(totals, keys) if keys else joined.crossJoin(totals)
    q, m = F.col("quantile"), F.col("_m")
    excess = (F.col("_s") - F.col("sum_upto")) - q * (m - F.col("rows_upto"))
    out = joined.withColumn("coverage", F.col("rows_upto") / m).withColumn("mean_width", 2.0 * q)
    return (
        out.withColumn("median_width", F.col("mean_width"))
        .withColumn(
            "normalized_interval_score", (2.0 * q + F.lit(2.0) / F.col("alpha") * excess / m) / F.lit(float(scale))
        )
        .withColumn("severe_undercoverage", F.col("coverage") < severe_threshold("alpha"))
        .drop("_m", "_s", "rows_upto", "sum_upto")
    )


def beta_binomial(grid: DataFrame, keys: Sequence[str], *, endpoints: int = ENDPOINTS) -> DataFrame:
    """Reference distribution of the covered count among ``endpoints`` evaluation endpoints."""
    if endpoints < 1:
        raise ContractError("the reference needs at least one endpoint")
    a = F.col("requested_rank")
    b = F.col("n_cal") + 1 - a
    x, m = F.col("covered_endpoints"), F.lit(endpoints).cast("bigint")
    rows = grid.filter(F.col("status") == EVALUATED).withColumn(
        "covered_endpoints", F.explode(F.sequence(F.lit(0).cast("bigint"), m))
    )
    logged = ln_choose(m, x) + ln_beta(x + a, m - x + b) - ln_beta(a, b)
    return rows.select(
        *keys, "cell_id", "n_cal", "alpha", "covered_endpoints",
        (x / m).alias("coverage"), F.exp(logged).alias("probability"),
    )


def beta_reference(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, sd, 5% and 10% quantiles and severe tail of Beta(r, n + 1 - r)."""
    a = F.col("requested_rank")
    b = F.col("n_cal") + 1 - a
    return grid.filter(F.col("status") == EVALUATED).select(
        *keys,
        "cell_id",
        "n_cal",
        "alpha",
        a.alias("a"),
        b.alias("b"),
        beta_mean(a, b).alias("mean"),
        beta_sd(a, b).alias("population_sd"),
        beta_quantile(F.lit(0.05), a, b).alias("quantile_05"),
        beta_quantile(F.lit(0.10), a, b).alias("quantile_10"),
        severe_threshold("alpha").alias("severe_threshold"),
        beta_cdf(severe_threshold("alpha"), a, b).alias("severe_probability"),
    )


# --- distances between distributions on the real line


def weighted_distribution(rows: DataFrame, keys: Sequence[str], *, value: str = "value", probability: str = "probability") -> DataFrame:
    """Equal values merged, one row per support point."""
    return rows.groupBy(*keys, F.col(value).alias("value")).agg(F.sum(probability).alias("probability"))


def _paired(finite: DataFrame, reference: DataFrame, keys: Sequence[str], ends: tuple[float, float] | None) -> DataFrame:
    """Union of both supports with the right- and left-limit of each CDF at every point, by a parallel prefix scan."""
    keys = list(keys)

    def side(rows: DataFrame, f: Column, g: Column) -> DataFrame:
        return rows.select(*keys, "value", f.alias("_f"), g.alias("_g"))

    both = side(finite, F.col("probability"), F.lit(0.0)).unionByName(side(reference, F.lit(0.0), F.col("probability")))
    if ends:
        marks = finite.select(*keys).distinct().withColumn("value", F.explode(F.array(*[F.lit(e) for e in ends])))
        both = both.unionByName(side(marks, F.lit(0.0), F.lit(0.0)))
    return running_totals(both, keys, "value", {"_f": "f", "_g": "g"}, following="following").select(
        *keys, "value", "f", "g", (F.col("f") - F.col("_f")).alias("f_left"), (F.col("g") - F.col("_g")).alias("g_left"), "following"
    )


def ks_discrete(finite: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greatest CDF gap over all jump points, from the right and from the left."""
    gaps = _paired(finite, reference, keys, None)
    gap = F.greatest(F.abs(F.col("f") - F.col("g")), F.abs(F.col("f_left") - F.col("g_left")))
    return gaps.groupBy(*keys).agg(F.max(gap).alias("ks_distance"))


def wasserstein_discrete(
    finite: DataFrame,
    reference: DataFrame,
    keys: Sequence[str],
    *,
    ends: tuple[float, float] | None = (0.0, 1.0),
) -> DataFrame:
    """Integral of the CDF gap; ``ends`` None for unbounded supports."""
    steps = _paired(finite, reference, keys, ends)
    area = (F.col("following") - F.col("value")) * F.abs(F.col("f") - F.col("g"))
    return steps.groupBy(*keys).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("wasserstein_1"))


def _cdf_steps(finite: DataFrame, keys: Sequence[str]) -> DataFrame:
    return running_totals(finite, keys, "value", {"probability": "f"}, following="following")


def beta_distances(finite: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """KS and Wasserstein-1 of a step CDF on [0, 1] against Beta(a, b), without quadrature.

    On a step the finite CDF is a constant c and the Beta CDF G rises, so the area between them
    splits at the quantile of c and both parts have a closed antiderivative.
    """
    keys = list(keys)
    params = reference.select(*keys, "a", "b")
    steps = _cdf_steps(finite, keys).join(params, keys)
    g = beta_cdf("value", "a", "b")
    gap = F.greatest(F.abs(F.col("f") - g), F.abs(F.col("f") - F.col("probability") - g))
    ks = steps.groupBy(*keys).agg(F.max(gap).alias("ks_distance"))
    lead_in = finite.groupBy(*keys).agg(F.min("value").alias("hi")).join(params, keys).select(
        *keys, "a", "b", F.lit(0.0).alias("lo"), "hi", F.lit(0.0).alias("f")
    )
    spans = steps.select(
        *keys, "a", "b", F.col("value").alias("lo"), F.coalesce("following", F.lit(1.0)).alias("hi"), F.least(F.col("f"), F.lit(1.0)).alias("f")
    ).unionByName(lead_in)
    turn = F.greatest(F.col("lo"), F.least(F.col("hi"), beta_quantile("f", "a", "b")))

    def integral(x: Column | str) -> Column:
        return beta_cdf_integral(x, "a", "b")

    cut = spans.withColumn("turn", turn)
    below = F.col("f") * (F.col("turn") - F.col("lo")) - (integral("turn") - integral("lo"))
    above = (integral("hi") - integral("turn")) - F.col("f") * (F.col("hi") - F.col("turn"))
    w1 = cut.groupBy(*keys).agg(F.sum(below + above).alias("wasserstein_1"))
    return ks.join(w1, keys)


def moments(finite: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population sd (centred second pass) and strict severe tail of a weighted distribution.

    ``alpha`` must be among the keys.
    """
    keys = list(keys)
    means = finite.groupBy(*keys).agg(F.sum(F.col("value") * F.col("probability")).alias("mean"))
    centred = F.col("value") - F.col("mean")
    return (
        finite.join(means, keys)
        .groupBy(*keys)
        .agg(
            F.max("mean").alias("mean"),
            F.sqrt(F.sum(F.col("probability") * centred * centred)).alias("sd"),
            F.coalesce(
                F.sum(F.when(F.col("value") < severe_threshold("alpha"), F.col("probability"))), F.lit(0.0)
            ).alias("tail"),
        )
    )


def discrepancies(
    outcomes: DataFrame, grid: DataFrame, keys: Sequence[str], *, endpoints: int = ENDPOINTS
) -> DataFrame:
    """Five signed or absolute distances per cell and reference; excluded cells stay as rows."""
    cells = [*keys, "cell_id", "n_cal", "alpha"]
    # Small tables that several branches read: a few rows per cell.
    finite = stored(weighted_distribution(outcomes, cells, value="coverage"), "audit-finite")
    binomial = stored(
        weighted_distribution(beta_binomial(grid, keys, endpoints=endpoints), cells, value="coverage"), "audit-binomial"
    )
    beta = stored(beta_reference(grid, keys), "audit-beta")
    own = moments(finite, cells).select(
        *cells,
        F.col("mean").alias("finite_mean_coverage"),
        F.col("sd").alias("finite_population_sd_coverage"),
        F.col("tail").alias("finite_severe_tail_probability"),
    )
    distinct = outcomes.groupBy(*cells).agg(F.count_distinct("quantile").alias("distinct_numerical_quantiles"))
    against_beta = beta_distances(finite, beta, cells).join(
        beta.select(
            *cells, F.col("mean").alias("_mean"), F.col("population_sd").alias("_sd"), F.col("severe_probability").alias("_tail")
        ),
        cells,
    ).withColumn("reference", F.lit("continuous_beta"))
    ref = moments(binomial, cells).select(*cells, F.col("mean").alias("_mean"), F.col("sd").alias("_sd"), F.col("tail").alias("_tail"))
    against_binomial = (
        ks_discrete(finite, binomial, cells)
        .join(wasserstein_discrete(finite, binomial, cells), cells)
        .join(ref, cells)
        .withColumn("reference", F.lit("beta_binomial"))
    )
    measured = (
        against_beta.unionByName(against_binomial)
        .join(own, cells)
        .join(distinct, cells)
        .withColumn("signed_mean_difference", F.col("finite_mean_coverage") - F.col("_mean"))
        .withColumn("signed_severe_tail_difference", F.col("finite_severe_tail_probability") - F.col("_tail"))
        .withColumn("signed_population_sd_difference", F.col("finite_population_sd_coverage") - F.col("_sd"))
        .drop("_mean", "_sd", "_tail")
    )
    declared = grid.select(*cells, "role", "status")
    return declared.join(measured, cells, "left").withColumn("reference", F.coalesce("reference", F.lit("not_evaluated")))


def empirical_wasserstein(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Wasserstein-1 between two equally weighted samples."""

    def sample(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("_c"))
        total = counts.groupBy(*keys).agg(F.sum("_c").alias("_t")) if keys else counts.agg(F.sum("_c").alias("_t"))
        joined = counts.join(total, list(keys)) if keys else counts.crossJoin(total)
        return joined.select(*keys, "value", (F.col("_c") / F.col("_t")).alias("probability"))

    return wasserstein_discrete(sample(left), sample(right), keys, ends=None)


def tie_diagnostics(rows: DataFrame, keys: Sequence[str], *, score: str = "score") -> DataFrame:
    """Rows that share their score with another row, and distinct scores."""
    counts = rows.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c"))), F.lit(0)).alias("tied_rows"),
        F.count(F.lit(1)).alias("distinct_scores"),
    )
