"""ANSI SQL of the checked queries: common table expressions shared by the oracles.

The text is written from the definition of each result, with plain window functions over whole
tables; it shares no code with the operators it checks.
"""

from __future__ import annotations

HEX8 = "CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"
HEX13 = "CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT)"
HEX15 = "CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT)"

EVENTS = """
ev AS (
  SELECT *, max(cycle) OVER (PARTITION BY entity_id) AS last_cycle,
         max(cycle) OVER (PARTITION BY entity_id) - cycle AS rul_raw
  FROM (
    SELECT user_id + 1 AS entity_id,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle,
           CAST(hour(ts) AS DOUBLE) AS op_setting_1, CAST(dayofweek(ts) AS DOUBLE) AS op_setting_2,
           CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                                WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS DOUBLE) AS op_setting_3,
           value AS sensor_1, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS sensor_2,
           CAST(1 AS DOUBLE) AS sensor_3
    FROM events))
"""

LINES = """
li AS (
  SELECT *, max(cycle) OVER (PARTITION BY entity_id) AS last_cycle,
         max(cycle) OVER (PARTITION BY entity_id) - cycle AS rul_raw
  FROM (
    SELECT r_name AS domain, l_suppkey + 1 AS entity_id,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
             l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS cycle,
           CAST(l_linenumber AS DOUBLE) AS op_setting_1,
           CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE -1 END AS DOUBLE) AS op_setting_2,
           CAST(CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS DOUBLE) AS op_setting_3,
           l_quantity AS sensor_1, l_extendedprice AS sensor_2, l_discount AS sensor_3, l_tax AS sensor_4
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey))
"""


def roles(panel: str, seeds: tuple[int, ...]) -> str:
    listed = ", ".join(f"({s})" for s in seeds)
    key = HEX15.format(key="seed || ':' || entity_id")
    return f"""
seeds AS (SELECT seed FROM (VALUES {listed}) t(seed)),
hashed AS (SELECT seed, entity_id, {key} AS h FROM seeds CROSS JOIN (SELECT DISTINCT entity_id FROM {panel})),
ordered AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY h, entity_id) AS rk,
                   count(*) OVER (PARTITION BY seed) AS n FROM hashed),
roles AS (SELECT seed, entity_id,
  CASE WHEN rk <= greatest(1, floor(n * CAST(0.6 AS DOUBLE))) THEN 'base_train'
       WHEN rk <= greatest(1, floor(n * CAST(0.6 AS DOUBLE))) + greatest(1, floor(n * CAST(0.2 AS DOUBLE))) THEN 'calibration'
       ELSE 'validation' END AS role FROM ordered)
"""


def cuts(panel: str, conditions: tuple[tuple, ...]) -> str:
    listed = ", ".join(
        f"('{c}', {cap}, {least}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for c, cap, least, lo, hi in conditions
    )
    key = HEX8.format(key="seed || ':' || condition || ':' || entity_id")
    return f"""
grid AS (SELECT * FROM (VALUES {listed}) t(condition, cap, min_observed, lower_fraction, upper_fraction) CROSS JOIN seeds),
ranged AS (SELECT seed, condition, cap, entity_id,
    greatest(min_observed, CAST(ceil(last_cycle * lower_fraction) AS BIGINT)) AS lo,
    CAST(floor(last_cycle * upper_fraction) AS BIGINT) AS hi
  FROM (SELECT DISTINCT entity_id, last_cycle FROM {panel}) CROSS JOIN grid),
cuts AS (SELECT seed, condition, cap, entity_id, lo + {key} % (hi - lo + 1) AS cut FROM ranged)
"""


def predictions(panel: str, *, extra: str = "", train_where: str = "TRUE", target_where: str = "FALSE") -> str:
    """Endpoint predictions of the two progress baselines; ``extra`` lists carried columns.

    Entities of ``target_where`` are all evaluated, whatever their role.
    """
    carried = f"{extra}, " if extra else ""
    return f"""
ends AS (SELECT p.*, c.seed, c.condition, c.cap, CASE WHEN {target_where} THEN 'validation' ELSE r.role END AS role,
    least(p.rul_raw, c.cap) AS rul_capped
  FROM cuts c JOIN roles r ON r.seed = c.seed AND r.entity_id = c.entity_id
  JOIN {panel} p ON p.entity_id = c.entity_id AND p.cycle = c.cut WHERE r.role <> 'base_train' OR {target_where}),
trained AS (SELECT g.seed, g.condition, CAST(floor(p.cycle / 10) AS BIGINT) AS bucket, CAST(least(p.rul_raw, g.cap) AS DOUBLE) AS y
  FROM grid g JOIN roles r ON r.seed = g.seed AND r.role = 'base_train'
  JOIN {panel} p ON p.entity_id = r.entity_id WHERE {train_where}),
overall AS (SELECT seed, condition, avg(y) AS m FROM trained GROUP BY ALL),
bybucket AS (SELECT seed, condition, bucket, avg(y) AS m FROM trained GROUP BY ALL),
predicted AS (
  SELECT e.*, 'mean' AS model, o.m AS pred_raw FROM ends e JOIN overall o USING (seed, condition)
  UNION ALL
  SELECT e.*, 'cycle_mean' AS model, coalesce(b.m, o.m) AS pred_raw FROM ends e JOIN overall o USING (seed, condition)
  LEFT JOIN bybucket b ON b.seed = e.seed AND b.condition = e.condition AND b.bucket = CAST(floor(e.cycle / 10) AS BIGINT)),
pred AS (SELECT {carried}seed, condition, cap, role, entity_id, cycle, rul_raw, rul_capped, model, pred_raw,
    greatest(0.0, least(pred_raw, cap)) AS pred,
    abs(rul_capped - greatest(0.0, least(pred_raw, cap))) AS score,
    CAST(rul_raw AS DOUBLE) AS y_true_raw, CAST(rul_capped AS DOUBLE) AS y_true,
    op_setting_1, op_setting_2, op_setting_3 FROM predicted)
"""


def quantiles(alphas: tuple[float, ...], *, where: str = "role = 'calibration'", policy: str = "raise") -> str:
    listed = ", ".join(f"(CAST({a} AS DOUBLE))" for a in alphas)
    effective = "least(requested_rank, n)" if policy == "legacy_max_clamp" else "CASE WHEN requested_rank <= n THEN requested_rank END"
    return f"""
alphas AS (SELECT alpha FROM (VALUES {listed}) t(alpha)),
cal AS (SELECT seed, condition, model, score,
    row_number() OVER (PARTITION BY seed, condition, model ORDER BY score) AS rk,
    count(*) OVER (PARTITION BY seed, condition, model) AS n FROM pred WHERE {where}),
asked AS (SELECT seed, condition, model, alpha, n, CAST(ceil((n + CAST(1 AS DOUBLE)) * (1 - alpha)) AS BIGINT) AS requested_rank
  FROM (SELECT DISTINCT seed, condition, model, n FROM cal) CROSS JOIN alphas),
decided AS (SELECT *, {effective} AS effective_rank, requested_rank <= n AS attainable,
    CASE WHEN requested_rank < n THEN 'interior' WHEN requested_rank = n THEN 'max_statistic'
         ELSE 'finite_quantile_unattainable' END AS regime FROM asked),
q AS (SELECT d.*, coalesce(c.score, CAST('infinity' AS DOUBLE)) AS quantile FROM decided d
  LEFT JOIN cal c ON c.seed = d.seed AND c.condition = d.condition AND c.model = d.model AND c.rk = d.effective_rank)
"""


INTERVALS = """
intervals AS (SELECT p.*, q.alpha, q.quantile, p.pred - q.quantile AS lower, p.pred + q.quantile AS upper
  FROM pred p JOIN q ON q.seed = p.seed AND q.condition = p.condition AND q.model = p.model WHERE p.role = 'validation')
"""

SCORED = """
scored AS (SELECT *, CASE WHEN y_true >= lower AND y_true <= upper THEN 1.0 ELSE 0.0 END AS hit, upper - lower AS width,
    ((upper - lower) + (2 / alpha) * (greatest(lower - y_true, 0) + greatest(y_true - upper, 0))) / cap AS nis
  FROM intervals)
"""


def r(expression: str, digits: int = 6) -> str:
    """Rounded, with negative zero removed."""
    return f"round({expression}, {digits}) + 0"


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()
