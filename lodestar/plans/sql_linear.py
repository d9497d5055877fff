"""SQL twins of the linear family on the full design (two numeric and two
one-hot predictors): co-moments in long form (g, i, j, v), solved by
Gauss-Jordan elimination or coordinate descent.

z0 = 1, z1 .. zp are the predictors standardised with the training rows' means
and population deviations, z(p+1) is the centred target.
"""

from __future__ import annotations

from lodestar.functions.hashing import sql_hash_u32
from lodestar.plans.facts import FACTS_SQL, with_sql
from lodestar.plans.q_split import SPLIT_SQL

NUMERIC, ONE_HOT = ["n_lines", "qty"], ["segment", "priority"]
# The categories of the given tables, the first of each left out.
LEVELS = [("segment", "BUILDING"), ("segment", "FURNITURE"), ("segment", "HOUSEHOLD"), ("segment", "MACHINERY"),
          ("priority", "2-HIGH"), ("priority", "3-MEDIUM"), ("priority", "4-NOT SPECIFIED"), ("priority", "5-LOW")]
NAMES = NUMERIC + [f"{c}_{v}".replace(" ", "_").replace("-", "_") for c, v in LEVELS]
P = len(NAMES)
FOLDS = 5
SWEEPS = 400          # coordinate-descent sweeps: far beyond convergence here

_X = [f"CAST({c} AS DOUBLE)" for c in NUMERIC] + [f"CAST({c} = '{v}' AS DOUBLE)" for c, v in LEVELS]
_z = ", ".join

Z_SQL = with_sql(FACTS_SQL, SPLIT_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
x AS (SELECT id, is_test, CAST({sql_hash_u32('id', "'fold42'")} % {FOLDS} AS INTEGER) AS fold, total AS y,
             {_z(f'{e} AS x{i + 1}' for i, e in enumerate(_X))} FROM split),
sc AS (SELECT AVG(y) AS my, {_z(f'AVG(x{i}) AS mu{i}, STDDEV_POP(x{i}) AS sd{i}' for i in range(1, P + 1))} FROM x WHERE NOT is_test),
z AS MATERIALIZED (SELECT id, is_test, fold, y, CAST(1.0 AS DOUBLE) AS z0, {_z(f'(x{i} - mu{i}) / sd{i} AS z{i}' for i in range(1, P + 1))},
                          y - my AS z{P + 1} FROM x, sc),
sd AS (SELECT UNNEST([{_z(str(i) for i in range(1, P + 1))}]) AS i, UNNEST([{_z(f'mu{i}' for i in range(1, P + 1))}]) AS mu,
              UNNEST([{_z(f'sd{i}' for i in range(1, P + 1))}]) AS sd, UNNEST([{_z(f"'{n}'" for n in NAMES)}]) AS term FROM sc)"""


def long_moments(name: str, key: str, src: str, weight: str = "") -> str:
    """CTE ``name`` (key, i, j, v) of the products of z0 .. z(p+1) over ``src``."""
    sums = _z(f"SUM({weight}z{i} * z{j}) AS c_{i}_{j}" for i in range(P + 2) for j in range(i, P + 2))
    return f"""
{name}_wide AS (SELECT {key}, {sums} FROM {src} GROUP BY ALL),
{name}_up AS (SELECT {key.split(' AS ')[-1]}, CAST(split_part(name, '_', 2) AS INTEGER) AS i, CAST(split_part(name, '_', 3) AS INTEGER) AS j, v
              FROM (UNPIVOT {name}_wide ON COLUMNS('^c_') INTO NAME name VALUE v)),
{name} AS MATERIALIZED (SELECT * FROM {name}_up UNION ALL SELECT * REPLACE (j AS i, i AS j) FROM {name}_up WHERE i < j)"""


def gauss_jordan(name: str, src: str, keys: list[str]) -> str:
    """CTE ``name`` (keys, i, b): solves the normal equations in ``src`` (keys,
    i, j, v), i = 0 .. p, right-hand side in j = p + 1."""
    k, out = _z(f"a.{c}" for c in keys), [f"{name}_0 AS MATERIALIZED (SELECT {_z([*keys, 'i', 'j', 'v'])} FROM {src} WHERE i <= {P})"]
    on = lambda t: " AND ".join([f"{t}.{c} = a.{c}" for c in keys] or ["TRUE"])
    for s in range(P + 1):
        out.append(f"""{name}_{s + 1} AS MATERIALIZED (SELECT {k + ', ' if keys else ''}a.i, a.j,
   CASE WHEN a.i = {s} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v FROM {name}_{s} a
   JOIN {name}_{s} p ON {on('p')} AND p.i = {s} AND p.j = {s}
   JOIN {name}_{s} c ON {on('c')} AND c.i = a.i AND c.j = {s}
   JOIN {name}_{s} r ON {on('r')} AND r.i = {s} AND r.j = a.j)""")
    out.append(f"{name} AS MATERIALIZED (SELECT {_z([*keys, 'i', 'v AS b'])} FROM {name}_{P + 1} WHERE j = {P + 1})")
    return "\n" + ",\n".join(out)


def coordinate_descent(name: str, src: str, params: str) -> str:
    """CTE ``name`` (g, l1, l2, i, b): elastic net on the co-moments of each
    group g of ``src``, for each row (g, l1, l2) of ``params``."""
    return f"""
{name}_c AS MATERIALIZED (SELECT a.g, a.i, a.j, (a.v - p.v * q.v / n.v) / n.v AS v FROM {src} a
   JOIN {src} n ON n.g = a.g AND n.i = 0 AND n.j = 0 JOIN {src} p ON p.g = a.g AND p.i = a.i AND p.j = 0
   JOIN {src} q ON q.g = a.g AND q.i = 0 AND q.j = a.j WHERE a.i > 0),
{name}_r AS MATERIALIZED (SELECT g, i, LIST(v ORDER BY j) FILTER (j BETWEEN 1 AND {P}) AS row, MAX(v) FILTER (j = {P + 1}) AS c,
   MAX(v) FILTER (j = i) AS d FROM {name}_c WHERE i <= {P} GROUP BY g, i),
{name}_s(g, l1, l2, step, b) AS (
   SELECT g, CAST(l1 AS DOUBLE), CAST(l2 AS DOUBLE), 0, [{_z(['CAST(0 AS DOUBLE)'] * P)}] FROM ({params})
   UNION ALL
   SELECT s.g, s.l1, s.l2, step + 1, list_concat(b[:r.i - 1], [
      sign(c - list_dot_product(r.row, b) + d * b[r.i]) * greatest(abs(c - list_dot_product(r.row, b) + d * b[r.i]) - l1, 0) / (d + l2)], b[r.i + 1:])
   FROM {name}_s s JOIN {name}_r r ON r.g = s.g AND r.i = step % {P} + 1 WHERE step < {P * SWEEPS}),
{name} AS MATERIALIZED (SELECT s.g, l1, l2, t.i, s.b[t.i] AS b FROM {name}_s s, range(1, {P + 1}) t(i) WHERE step = {P * SWEEPS})"""


CUBE = Z_SQL + "," + long_moments("cube", "CASE WHEN is_test THEN -1 ELSE fold END AS g", "z") + """,
whole AS MATERIALIZED (SELECT 0 AS g, i, j, SUM(v) AS v FROM cube WHERE g >= 0 GROUP BY i, j),
kept AS MATERIALIZED (SELECT f.g, w.i, w.j, w.v - f.v AS v FROM whole w JOIN cube f ON f.i = w.i AND f.j = w.j WHERE f.g >= 0)"""


def grid_scores(name: str, coefs: str) -> str:
    """CTE ``name`` (alpha, mean_r2): mean held-out R2 over the folds of the
    coefficients ``coefs`` (g, alpha, i, b), i = 0 .. p."""
    return f"""
{name}_v AS (SELECT g, alpha, i, -b AS b FROM {coefs} UNION ALL SELECT DISTINCT g, alpha, {P + 1}, 1.0 FROM {coefs}),
{name}_e AS (SELECT a.g, a.alpha, SUM(a.b * b.b * m.v) AS sse FROM {name}_v a JOIN {name}_v b ON b.g = a.g AND b.alpha = a.alpha
             JOIN cube m ON m.g = a.g AND m.i = a.i AND m.j = b.i GROUP BY a.g, a.alpha),
{name} AS MATERIALIZED (SELECT alpha, AVG(1 - sse / (yy.v - y.v * y.v / n.v)) AS mean_r2 FROM {name}_e e
   JOIN cube yy ON yy.g = e.g AND yy.i = {P + 1} AND yy.j = {P + 1} JOIN cube y ON y.g = e.g AND y.i = 0 AND y.j = {P + 1}
   JOIN cube n ON n.g = e.g AND n.i = 0 AND n.j = 0 GROUP BY alpha)"""


def with_intercept(name: str, slopes: str, src: str) -> str:
    """CTE ``name`` (g, alpha, i, b): the unpenalised intercept added to slopes (g, l1, i, b)."""
    return f"""
{name} AS MATERIALIZED (SELECT g, l1 AS alpha, i, b FROM {slopes} UNION ALL
   SELECT s.g, s.l1, 0, MAX(y.v / n.v) - SUM(s.b * m.v / n.v) FROM {slopes} s JOIN {src} m ON m.g = s.g AND m.i = 0 AND m.j = s.i
   JOIN {src} n ON n.g = s.g AND n.i = 0 AND n.j = 0 JOIN {src} y ON y.g = s.g AND y.i = 0 AND y.j = {P + 1} GROUP BY s.g, s.l1)"""


def alphas(values: list[float]) -> str:
    return " UNION ALL ".join(f"SELECT CAST({a!r} AS DOUBLE) AS alpha" for a in values)


def ridge_grid(name: str, values: list[float]) -> str:
    """CTE ``name`` (alpha, mean_r2) of ridge over the folds."""
    return f"""
{name}_a AS ({alphas(values)}),
{name}_m AS (SELECT g, alpha, i, j, v + CASE WHEN i = j AND i BETWEEN 1 AND {P} THEN alpha ELSE 0 END AS v FROM kept, {name}_a),""" + \
        gauss_jordan(f"{name}_b", f"{name}_m", ["g", "alpha"]) + "," + grid_scores(name, f"{name}_b")


def lasso_grid(name: str, values: list[float]) -> str:
    """CTE ``name`` (alpha, mean_r2) of the lasso over the folds."""
    params = f"SELECT DISTINCT k.g, alpha AS l1, 0.0 AS l2 FROM kept k, ({alphas(values)})"
    return coordinate_descent(f"{name}_s", "kept", params) + "," + with_intercept(f"{name}_b", f"{name}_s", "kept") + "," + \
        grid_scores(name, f"{name}_b")
