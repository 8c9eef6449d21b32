"""Exact finite-reservoir audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcal.operators import reservoir, split
from panelcal.plans import sql
from panelcal.plans.queries import base
from panelcal.plans.registry import r, register
from panelcal.plans.workloads import audit_grid, reservoir_audit
from panelcal.plans.workloads import audit_outcomes as outcomes_of
from panelcal.schema import ENTITY
from panelcal.session import configure

KEYS = ["seed", "model"]
CELLS = (
    ("primary", 10, 0.10),
    ("primary", 15, 0.10),
    ("primary", 20, 0.10),
    ("secondary", 20, 0.05),
    ("secondary", 25, 0.20),
    ("secondary", 10, 0.05),
    ("secondary", 100000, 0.10),
)

_CELLS = f"""
cells AS (SELECT role, CAST(n AS BIGINT) AS n_cal, CAST(a AS DOUBLE) AS alpha FROM (VALUES {', '.join(f"('{x}', {n}, {a})" for x, n, a in CELLS)}) t(role, n, a)),
res AS (SELECT seed, model, score, row_number() OVER (PARTITION BY seed, model ORDER BY score) AS position FROM pred WHERE role = 'calibration'),
ressize AS (SELECT seed, model, count(*) AS n_res FROM res GROUP BY ALL),
cellgrid AS (SELECT *, CASE WHEN rk > n_cal THEN 'excluded_unattainable' WHEN n_cal >= n_res THEN 'excluded_degenerate' ELSE 'evaluate' END AS status,
    'n' || n_cal || '_alpha_' || alpha AS cell_id
  FROM (SELECT *, CAST(ceil((n_cal + CAST(1 AS DOUBLE)) * (1 - alpha)) AS BIGINT) AS rk FROM ressize CROSS JOIN cells))
"""
_CHOOSE = "CAST(round(exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))) AS BIGINT)"
_MASSES = f"""
masses AS (SELECT g.seed, g.model, g.cell_id, g.role, g.n_cal, g.alpha, r.score AS quantile, r.position,
    {_CHOOSE.format(n='(r.position - 1)', k='(g.rk - 1)')} * {_CHOOSE.format(n='(g.n_res - r.position)', k='(g.n_cal - g.rk)')} AS m,
    {_CHOOSE.format(n='g.n_res', k='g.n_cal')} AS c
  FROM cellgrid g JOIN res r ON r.seed = g.seed AND r.model = g.model AND r.position BETWEEN g.rk AND g.n_res - g.n_cal + g.rk
  WHERE status = 'evaluate'),
dist AS (SELECT seed, model, cell_id, role, n_cal, alpha, quantile, min(position) AS position_min, max(position) AS position_max,
    '{{' || string_agg('"' || position || '":' || m, ',' ORDER BY CAST(position AS VARCHAR)) || '}}' AS position_multiplicities,
    CAST(sum(m) AS BIGINT) AS multiplicity, max(c) AS combination_count, CAST(sum(m) AS DOUBLE) / max(c) AS probability
  FROM masses GROUP BY ALL),
evaluation AS (SELECT seed, model, score FROM pred WHERE role = 'validation'),
outcomes AS (SELECT d.seed, d.model, d.cell_id, d.n_cal, d.alpha, d.quantile, any_value(d.probability) AS probability,
    avg(CASE WHEN e.score <= d.quantile THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS coverage, 2 * d.quantile AS mean_width,
    avg(2 * d.quantile + 2 / d.alpha * greatest(e.score - d.quantile, 0)) / 125 AS normalized_interval_score
  FROM dist d JOIN evaluation e ON e.seed = d.seed AND e.model = d.model GROUP BY d.seed, d.model, d.cell_id, d.n_cal, d.alpha, d.quantile),
finite AS (SELECT seed, model, cell_id, n_cal, alpha, coverage AS value, sum(probability) AS p FROM outcomes GROUP BY ALL),
bb AS (SELECT seed, model, cell_id, n_cal, alpha, CAST(x AS BIGINT) AS covered_endpoints, x / CAST(100 AS DOUBLE) AS value,
    exp(lgamma(101) - lgamma(x + 1) - lgamma(100 - x + 1) + lgamma(x + rk) + lgamma(100 - x + n_cal + 1 - rk) - lgamma(100 + n_cal + 1)
      - lgamma(rk) - lgamma(n_cal + 1 - rk) + lgamma(n_cal + 1)) AS p
  FROM cellgrid CROSS JOIN (SELECT range AS x FROM range(101)) WHERE status = 'evaluate')
"""
_AUDIT = base.event_ctes(_CELLS, _MASSES)


def _grid(spark, sf_dir):
    return audit_grid(base.event_predictions(spark, sf_dir), reservoir.declared_cells(spark, CELLS), KEYS)


def _audit(spark, sf_dir):
    cells = reservoir.declared_cells(configure(spark), CELLS)
    return reservoir_audit(base.event_predictions(spark, sf_dir), cells, KEYS)


@register(
    "audit_cells",
    sql.query(
        base.event_ctes(_CELLS),
        f"""SELECT seed, model, cell_id, role, n_cal, alpha, status, n_res AS reservoir_size, rk AS requested_rank, rk <= n_cal AS finite_rank_attainable,
        CASE WHEN rk < n_cal THEN 'interior' WHEN rk = n_cal THEN 'max_statistic' ELSE 'finite_quantile_unattainable' END AS regime,
        CASE WHEN status = 'evaluate' THEN rk END AS support_position_min, CASE WHEN status = 'evaluate' THEN n_res - n_cal + rk END AS support_position_max,
        CASE WHEN status = 'evaluate' THEN CAST({_CHOOSE.format(n='n_res', k='n_cal')} AS VARCHAR) END AS combination_count,
        {sql.r('(n_res - n_cal) / CAST(n_res - 1 AS DOUBLE)')} AS finite_population_factor FROM cellgrid""",
    ),
)
def audit_cells(spark, sf_dir):
    scores = base.event_predictions(spark, sf_dir).filter(F.col("role") == split.CALIBRATION)
    sizes = scores.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("reservoir_size"))
    grid = reservoir.cell_grid(reservoir.declared_cells(spark, CELLS), sizes)
    return grid.select(
        *KEYS, "cell_id", "role", "n_cal", "alpha", "status", "reservoir_size", "requested_rank", "finite_rank_attainable",
        "regime", "support_position_min", "support_position_max", F.col("combination_count").cast("string").alias("combination_count"),
        r("finite_population_factor"),
    )


@register(
    "audit_quantile_distribution",
    sql.query(
        _AUDIT,
        f"""SELECT seed, model, cell_id, role, n_cal, alpha, {sql.r('quantile')} AS quantile, position_min, position_max, position_multiplicities,
        CAST(multiplicity AS VARCHAR) AS multiplicity, CAST(combination_count AS VARCHAR) AS combination_count, {sql.r('probability', 9)} AS probability
        FROM dist""",
    ),
)
def audit_quantile_distribution(spark, sf_dir):
    store = base.event_predictions(spark, sf_dir).filter(F.col("role") == split.CALIBRATION)
    sizes = store.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("reservoir_size"))
    grid = reservoir.cell_grid(reservoir.declared_cells(spark, CELLS), sizes)
    found = reservoir.quantile_distribution(store, grid, KEYS)
    return found.select(
        *KEYS, "cell_id", "role", "n_cal", "alpha", r("quantile"), "position_min", "position_max", "position_multiplicities",
        F.col("multiplicity").cast("string").alias("multiplicity"),
        F.col("combination_count").cast("string").alias("combination_count"), r("probability", 9),
    )


@register(
    "audit_outcomes",
    sql.query(
        _AUDIT,
        f"""SELECT seed, model, cell_id, {sql.r('quantile')} AS quantile, {sql.r('probability', 9)} AS probability, {sql.r('coverage')} AS coverage,
        {sql.r('mean_width')} AS mean_width, {sql.r('normalized_interval_score')} AS normalized_interval_score,
        coverage < (1 - alpha) - CAST(0.1 AS DOUBLE) AS severe_undercoverage FROM outcomes""",
    ),
)
def audit_outcomes(spark, sf_dir):
    predictions = base.event_predictions(spark, sf_dir)
    grid = audit_grid(predictions, reservoir.declared_cells(spark, CELLS), KEYS)
    found = outcomes_of(predictions, grid, KEYS)
    return found.select(
        *KEYS, "cell_id", r("quantile"), r("probability", 9), r("coverage"), r("mean_width"), r("normalized_interval_score"),
        "severe_undercoverage",
    )


@register(
    "audit_beta_binomial",
    sql.query(_AUDIT, f"SELECT seed, model, cell_id, covered_endpoints, {sql.r('value')} AS coverage, {sql.r('p', 9)} AS probability FROM bb"),
)
def audit_beta_binomial(spark, sf_dir):
    found = reservoir.beta_binomial(_grid(spark, sf_dir), KEYS)
    return found.select(*KEYS, "cell_id", "covered_endpoints", r("coverage"), r("probability", 9))


#: Quantiles of the Beta reference by halving its binomial tail.
_HALVED = """
halved AS (
  SELECT seed, model, cell_id, CAST(rk AS BIGINT) AS r, CAST(n_cal AS BIGINT) AS n, CAST(p AS DOUBLE) AS target, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS i
  FROM cellgrid CROSS JOIN (VALUES (0.05), (0.1)) t(p) WHERE status = 'evaluate'
  UNION ALL
  SELECT seed, model, cell_id, r, n, target, CASE WHEN tail < target THEN mid ELSE lo END, CASE WHEN tail < target THEN hi ELSE mid END, i + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
      + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2)) FOR j IN range(r, n + 1)]) AS tail FROM halved WHERE i < 50))
"""


@register(
    "audit_beta_reference",
    sql.query(
        [*_AUDIT, _HALVED],
        f"""SELECT g.seed, g.model, g.cell_id, rk AS a, n_cal + 1 - rk AS b, {sql.r('rk / CAST(n_cal + 1 AS DOUBLE)', 9)} AS mean,
        {sql.r('sqrt(rk * (n_cal + 1 - rk) / ((n_cal + CAST(1 AS DOUBLE)) * (n_cal + 1) * (n_cal + 2)))', 9)} AS population_sd,
        {sql.r('''(SELECT sum(exp(lgamma(n_cal + 1) - lgamma(j + 1) - lgamma(n_cal - j + 1) + j * ln(1 - alpha - 0.1) + (n_cal - j) * ln(1 - (1 - alpha - 0.1))))
          FROM (SELECT range AS j FROM range(101)) WHERE j BETWEEN rk AND n_cal)''', 9)} AS severe_probability,
        {sql.r("(SELECT (lo + hi) / 2 FROM halved h WHERE h.i = 50 AND h.target = 0.05 AND h.seed = g.seed AND h.model = g.model AND h.cell_id = g.cell_id)", 9)} AS quantile_05,
        {sql.r("(SELECT (lo + hi) / 2 FROM halved h WHERE h.i = 50 AND h.target = 0.1 AND h.seed = g.seed AND h.model = g.model AND h.cell_id = g.cell_id)", 9)} AS quantile_10
        FROM cellgrid g WHERE status = 'evaluate'""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def audit_beta_reference(spark, sf_dir):
    found = reservoir.beta_reference(_grid(spark, sf_dir), KEYS)
    return found.select(*KEYS, "cell_id", "a", "b", r("mean", 9), r("population_sd", 9), r("severe_probability", 9), r("quantile_05", 9), r("quantile_10", 9))


_DISTANCES = """
points AS (SELECT seed, model, cell_id, value FROM finite UNION SELECT seed, model, cell_id, value FROM bb
  UNION SELECT DISTINCT seed, model, cell_id, e FROM finite CROSS JOIN (VALUES (CAST(0 AS DOUBLE)), (CAST(1 AS DOUBLE))) t(e)),
joined AS (SELECT p.*, coalesce(f.p, 0) AS fp, coalesce(b.p, 0) AS gp FROM points p
  LEFT JOIN finite f USING (seed, model, cell_id, value) LEFT JOIN bb b USING (seed, model, cell_id, value)),
cdfs AS (SELECT *, sum(fp) OVER w AS f, sum(gp) OVER w AS g, lead(value) OVER w AS following FROM joined
  WINDOW w AS (PARTITION BY seed, model, cell_id ORDER BY value)),
dist2 AS (SELECT seed, model, cell_id, max(greatest(abs(f - g), abs((f - fp) - (g - gp)))) AS ks, sum((following - value) * abs(f - g)) AS w1
  FROM cdfs GROUP BY ALL),
fm AS (SELECT seed, model, cell_id, alpha, sum(value * p) AS mean FROM finite GROUP BY ALL),
gm AS (SELECT seed, model, cell_id, sum(value * p) AS mean FROM bb GROUP BY ALL),
fs AS (SELECT f.seed, f.model, f.cell_id, any_value(m.mean) AS mean, sqrt(sum(p * (value - m.mean) * (value - m.mean))) AS sd,
    coalesce(sum(p) FILTER (value < (1 - f.alpha) - CAST(0.1 AS DOUBLE)), 0) AS tail
  FROM finite f JOIN fm m USING (seed, model, cell_id) GROUP BY f.seed, f.model, f.cell_id),
gs AS (SELECT b.seed, b.model, b.cell_id, any_value(m.mean) AS mean, sqrt(sum(p * (value - m.mean) * (value - m.mean))) AS sd,
    coalesce(sum(p) FILTER (value < (1 - b.alpha) - CAST(0.1 AS DOUBLE)), 0) AS tail
  FROM bb b JOIN gm m USING (seed, model, cell_id) GROUP BY b.seed, b.model, b.cell_id)
"""


@register(
    "audit_discrepancies",
    sql.query(
        [*_AUDIT, _DISTANCES],
        f"""SELECT c.seed, c.model, c.cell_id, c.role, c.status, {sql.r('fs.mean')} AS finite_mean_coverage, {sql.r('fs.sd')} AS finite_population_sd_coverage,
        {sql.r('fs.tail')} AS finite_severe_tail_probability, {sql.r('ks')} AS ks_distance, {sql.r('w1')} AS wasserstein_1,
        {sql.r('fs.mean - gs.mean')} AS signed_mean_difference, {sql.r('fs.sd - gs.sd')} AS signed_population_sd_difference,
        {sql.r('fs.tail - gs.tail')} AS signed_severe_tail_difference
        FROM cellgrid c LEFT JOIN fs USING (seed, model, cell_id) LEFT JOIN gs USING (seed, model, cell_id) LEFT JOIN dist2 USING (seed, model, cell_id)""",
    ),
)
def audit_discrepancies(spark, sf_dir):
    """Against the beta-binomial reference; excluded cells stay as rows."""
    found = _audit(spark, sf_dir)["discrepancies"].filter(F.col("reference") != "continuous_beta")
    return found.select(
        *KEYS, "cell_id", "role", "status", r("finite_mean_coverage"), r("finite_population_sd_coverage"),
        r("finite_severe_tail_probability"), r("ks_distance"), r("wasserstein_1"), r("signed_mean_difference"),
        r("signed_population_sd_difference"), r("signed_severe_tail_difference"),
    )


@register("audit_beta_discrepancies")
def audit_beta_discrepancies(spark, sf_dir):
    """Against the continuous Beta reference: closed-form Wasserstein, checked in tests against integration."""
    found = _audit(spark, sf_dir)["discrepancies"].filter(F.col("reference") == "continuous_beta")
    return found.select(*KEYS, "cell_id", "distinct_numerical_quantiles", r("ks_distance"), r("wasserstein_1"), r("signed_mean_difference"))


@register(
    "score_ties",
    sql.query(
        base.event_ctes(),
        """SELECT seed, model, coalesce(sum(c) FILTER (c > 1), 0) AS tied_rows, count(*) AS distinct_scores
        FROM (SELECT seed, model, score, count(*) AS c FROM pred GROUP BY ALL) GROUP BY ALL""",
    ),
)
def score_ties(spark, sf_dir):
    return reservoir.tie_diagnostics(base.event_predictions(spark, sf_dir), KEYS).select(*KEYS, "tied_rows", "distinct_scores")


_W1 = """
a AS (SELECT l_returnflag AS flag, l_quantity * 7 + l_linenumber AS v FROM lineitem WHERE l_linestatus = 'F'),
b AS (SELECT l_returnflag AS flag, l_quantity * 7 + l_linenumber AS v FROM lineitem WHERE l_linestatus = 'O'),
pa AS (SELECT flag, v, count(*) / CAST(sum(count(*)) OVER (PARTITION BY flag) AS DOUBLE) AS p FROM a GROUP BY flag, v),
pb AS (SELECT flag, v, count(*) / CAST(sum(count(*)) OVER (PARTITION BY flag) AS DOUBLE) AS p FROM b GROUP BY flag, v),
u AS (SELECT flag, v, sum(f) AS f, sum(g) AS g FROM (SELECT flag, v, p AS f, 0 AS g FROM pa UNION ALL SELECT flag, v, 0, p FROM pb) GROUP BY flag, v),
s AS (SELECT flag, v, sum(f) OVER w AS f, sum(g) OVER w AS g, lead(v) OVER w AS following FROM u WINDOW w AS (PARTITION BY flag ORDER BY v))
"""


@register(
    "empirical_wasserstein",
    sql.query([_W1], f"SELECT flag, {sql.r('sum((following - v) * abs(f - g))')} AS wasserstein_1 FROM s GROUP BY 1"),
)
def empirical_wasserstein(spark, sf_dir):
    from panelcal.plans.panels import table

    lines = table(configure(spark), sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), "l_linestatus", (F.col("l_quantity") * 7 + F.col("l_linenumber")).alias("v")
    )
    left, right = lines.filter("l_linestatus = 'F'"), lines.filter("l_linestatus = 'O'")
    return reservoir.empirical_wasserstein(left, right, ["flag"], "v").select("flag", r("wasserstein_1"))


@register(
    "cut_cycle_wasserstein",
    sql.query(
        [
            *base.event_ctes(),
            """a AS (SELECT seed, v, count(*) / CAST(sum(count(*)) OVER (PARTITION BY seed) AS DOUBLE) AS p FROM
               (SELECT DISTINCT seed, entity_id, CAST(cycle AS DOUBLE) AS v FROM pred WHERE role = 'calibration') GROUP BY seed, v),
            b AS (SELECT seed, v, count(*) / CAST(sum(count(*)) OVER (PARTITION BY seed) AS DOUBLE) AS p FROM
               (SELECT DISTINCT seed, entity_id, CAST(cycle AS DOUBLE) AS v FROM pred WHERE role = 'validation') GROUP BY seed, v),
            u AS (SELECT seed, v, sum(f) AS f, sum(g) AS g FROM (SELECT seed, v, p AS f, 0 AS g FROM a UNION ALL SELECT seed, v, 0, p FROM b) GROUP BY seed, v),
            s AS (SELECT seed, v, sum(f) OVER w AS f, sum(g) OVER w AS g, lead(v) OVER w AS following FROM u WINDOW w AS (PARTITION BY seed ORDER BY v))""",
        ],
        f"SELECT seed, {sql.r('sum((following - v) * abs(f - g))')} AS wasserstein_1 FROM s GROUP BY 1",
    ),
)
def cut_cycle_wasserstein(spark, sf_dir):
    """Observed-cycle gap between calibration prefixes and evaluation prefixes."""
    rows = base.event_predictions(spark, sf_dir).filter(F.col("model") == "mean").select("seed", "role", ENTITY, "cycle")
    left, right = rows.filter(F.col("role") == split.CALIBRATION), rows.filter(F.col("role") == split.VALIDATION)
    return reservoir.empirical_wasserstein(left, right, ["seed"], "cycle").select("seed", r("wasserstein_1"))
