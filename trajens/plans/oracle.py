"""DuckDB SQL for the correctness oracle.

``BASE`` re-derives the domain tables from the test tables in plain SQL
(independently of the Spark adapter); each query appends its own SELECT.
All doubles are rounded to 6 dp on both sides.
"""

from __future__ import annotations

from trajens.functions.quantiles import PLOT_LEVELS, QUANTILE_LEVELS, label


def levels_values(levels=QUANTILE_LEVELS) -> str:
    rows = ", ".join(f"({i + 1}, CAST({p!r} AS DOUBLE), '{label(p)}')" for i, p in enumerate(levels))
    return f"(VALUES {rows}) AS lv(idx, quantile_level, quantile)"


def levels_list(levels=QUANTILE_LEVELS) -> str:
    return "[" + ", ".join(f"CAST({p!r} AS DOUBLE)" for p in levels) + "]"


def base(level: str = "region", n_model_min: int = 3) -> str:
    loc = "r.r_name" if level == "region" else "n.n_name"
    return f"""
WITH last_day AS (SELECT max(CAST(l_shipdate AS DATE)) AS last_date FROM lineitem),
new_year AS (
  SELECT last_date, make_date(year(last_date + CAST(3 - dayofweek(last_date) AS INTEGER)), 1, 1) AS ny FROM last_day),
season AS (
  SELECT ny + CAST(((3 - dayofweek(ny)) % 7 + 7) % 7 - 3 AS INTEGER) AS origin, last_date FROM new_year),
facts AS (
  SELECT {loc} AS location, c.c_mktsegment AS model, l.l_quantity, l.l_linestatus,
         CAST(l.l_shipdate AS DATE) AS ship_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
pf AS (
  SELECT *, ship_date + CAST(3 - dayofweek(ship_date) AS INTEGER) AS wed FROM facts
  WHERE ship_date < (SELECT origin FROM season)),
cells AS (
  SELECT location, model, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS scenario_id,
         CAST(year(wed) AS INTEGER) AS sample,
         CAST((dayofyear(wed) - 1) // 7 + 1 AS INTEGER) AS week,
         sum(l_quantity) AS sum_qty, count(*) AS n_lines
  FROM pf GROUP BY ALL),
raw AS (
  SELECT model, location, scenario_id, 'inc case' AS target_variable,
         CAST(week AS VARCHAR) || ' wk' AS horizon, sample, sum_qty AS value FROM cells
  UNION ALL
  SELECT model, location, scenario_id, 'inc death', CAST(week AS VARCHAR) || ' wk', sample,
         CAST(n_lines AS DOUBLE) FROM cells),
tdays AS (
  SELECT location, ship_date AS date, sum(l_quantity) AS sum_qty, count(*) AS n_lines
  FROM facts WHERE ship_date >= (SELECT origin FROM season) GROUP BY ALL),
truth_daily AS (
  SELECT location, location AS location_name, date,
         sum_qty / 10 AS value, 'inc case' AS target_variable FROM tdays
  UNION ALL
  SELECT location, location, date, n_lines / 10, 'inc death' FROM tdays),
pop AS (
  SELECT {loc} AS location, CAST(count(*) AS DOUBLE) * 1000 AS population
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1),
obs AS (
  SELECT w.location, w.location_name, w.target_variable, w.target_end_date, w.value,
         p.population, 'Observed' AS model
  FROM (SELECT location, location_name, target_variable, max(date) AS target_end_date,
               CAST(round(CAST(coalesce(sum(value), 0) AS DECIMAL(38, 15)), 9) AS DOUBLE) AS value
        FROM (SELECT *, date + CAST(3 - dayofweek(date) AS INTEGER) AS wed FROM truth_daily)
        GROUP BY location, location_name, target_variable, year(wed), (dayofyear(wed) - 1) // 7) w
  LEFT JOIN pop p ON w.location = p.location),
r1 AS (
  SELECT 2 AS round, location, scenario_id, target_variable, model, sample,
         CAST(regexp_extract(horizon, '(\\d+)', 1) AS INTEGER) AS horizon, value,
         (SELECT origin FROM season) + (7 * CAST(regexp_extract(horizon, '(\\d+)', 1) AS INTEGER) - 1) AS target_end_date
  FROM raw),
thin AS (
  SELECT round, location, scenario_id, target_end_date, target_variable FROM r1
  GROUP BY ALL HAVING count(DISTINCT model) < {n_model_min}),
r2 AS (
  SELECT r1.* FROM r1 ANTI JOIN thin USING (round, location, scenario_id, target_end_date, target_variable)),
sp AS (
  SELECT location, target_variable, location_name, arg_min(population, target_end_date) AS population
  FROM obs GROUP BY location, target_variable, location_name),
results AS (
  SELECT r2.*, o.value AS obs, sp.location_name, sp.population,
         r2.value / sp.population * 100000 AS value_100k,
         o.value / sp.population * 100000 AS obs_100k
  FROM r2
  LEFT JOIN obs o ON r2.location = o.location AND r2.target_variable = o.target_variable
                 AND r2.target_end_date = o.target_end_date
  LEFT JOIN sp ON r2.location = sp.location AND r2.target_variable = sp.target_variable)
"""


def with_ctes(sql_base: str, *ctes: str) -> str:
    """Append extra ``name AS (...)`` CTEs to a base WITH clause."""
    out = sql_base.rstrip()
    for c in ctes:
        out += ",\n" + c.strip()
    return out + "\n"


def beta_cdf(x: str, a: str, b: str, steps: int = 40) -> str:
    """Regularised incomplete beta I_x(a, b) as one SQL expression: the continued fraction of
    DLMF 8.17.22 cut after ``steps`` terms, evaluated from the inside out, mirrored where it
    converges badly. ``x``, ``a``, ``b``: column names."""
    def half(x, a, b):
        d = (f"(CASE WHEN k % 2 = 0 THEN (k / 2) * ({b} - k / 2) "
             f"ELSE -({a} + (k - 1) / 2) * ({a} + {b} + (k - 1) / 2) END * {x} / (({a} + k - 1) * ({a} + k)))")
        steps_ = f"list_prepend(1.0::DOUBLE, list_transform(range({steps}, 0, -1), lambda i: i::DOUBLE))"
        front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a}"
        return f"{front} / list_reduce({steps_}, lambda r, k: 1.0 + {d} / r)"
    return (f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 "
            f"WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {half(x, a, b)} "
            f"ELSE 1.0 - ({half(f'(1 - {x})', b, a)}) END")


ENS_KEYS_SQL = "round, location, target_variable, target_end_date, scenario_id"
