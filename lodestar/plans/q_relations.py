"""Step 5: correlation, distribution shape and residual diagnostics (2D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import relations as rl
from lodestar.plans.facts import FACTS_SQL, facts, with_sql
from lodestar.plans.registry import query

NUM = ["n_lines", "qty", "total"]

FIT_SQL = """fit AS (SELECT regr_slope(total, n_lines) AS slope, regr_intercept(total, n_lines) AS intercept FROM facts),
res AS (SELECT f.id, f.segment, f.total, intercept + slope * CAST(f.n_lines AS DOUBLE) AS pred,
               f.total - (intercept + slope * CAST(f.n_lines AS DOUBLE)) AS residual FROM facts f, fit)"""


def _res(spark, sf):
    return rl.with_residuals(facts(spark, sf), "total", "n_lines")


@query("corr_pair", with_sql(FACTS_SQL) + "SELECT ROUND(corr(total, n_lines), 6) AS r FROM facts")
def corr_pair(spark, sf):
    """Pearson correlation of one pair."""
    return facts(spark, sf).agg(F.round(F.corr("total", F.col("n_lines").cast("double")), 6).alias("r"))


def _corr_sql(where=""):
    parts = []
    for i, a in enumerate(NUM):
        for b in NUM[i + 1:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(corr({a}, {b}), 4) AS r FROM facts")
            parts.append(f"SELECT '{b}' AS a, '{a}' AS b, ROUND(corr({a}, {b}), 4) AS r FROM facts")
        parts.append(f"SELECT '{a}' AS a, '{a}' AS b, 1.0::DOUBLE AS r")
    return with_sql(FACTS_SQL) + "\nUNION ALL\n".join(parts)


@query("corr_matrix", _corr_sql())
def corr_matrix(spark, sf):
    return rl.corr_long(facts(spark, sf), NUM)


@query("high_corr_pairs", """SELECT a, b, r, CASE WHEN abs(r) > 0.9 THEN 'Muy Alta' WHEN abs(r) > 0.7 THEN 'Alta'
  ELSE 'Moderada' END AS strength FROM (""" + _corr_sql() + """) m
  WHERE a < b AND abs(r) > 0.8""")
def high_corr_pairs(spark, sf):
    """Upper-triangle pairs above 0.8 with a strength label."""
    m = rl.corr_long(facts(spark, sf), NUM)
    return m.where((F.col("a") < F.col("b")) & (F.abs("r") > 0.8)).withColumn("strength", rl.strength_label(F.col("r")))


@query("corr_advice", """SELECT a, b, r, CASE WHEN abs(r) > 0.9 THEN 'Muy Alta' WHEN abs(r) > 0.7 THEN 'Alta' ELSE 'Moderada' END AS strength,
  CASE WHEN b <> 'total' AND r > 0.95 THEN 'regularise' WHEN b = 'total' AND r > 0.9 THEN 'linear' ELSE 'none' END AS advice FROM (""" + with_sql(FACTS_SQL) + """,
  f AS (SELECT CAST(n_lines AS DOUBLE) AS n_lines, qty, n_lines * n_lines AS n_lines2, total FROM facts)
  """ + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(corr({a}, {b}), 4) AS r FROM f" for a, b in
                          [("n_lines", "n_lines2"), ("n_lines", "qty"), ("n_lines", "total"), ("n_lines2", "qty"), ("n_lines2", "total"), ("qty", "total")]) + ") m")
def corr_advice(spark, sf):
    """Every pair of predictors (a count, its square, a quantity) and the
    target, with its strength label and the advice for the model."""
    cols = ["n_lines", "n_lines2", "qty", "total"]
    f = facts(spark, sf).withColumn("n_lines2", F.col("n_lines") * F.col("n_lines"))
    order = lambda c: F.array_position(F.array(*[F.lit(x) for x in cols]), F.col(c))
    m = rl.corr_long(f, cols).where(order("a") < order("b"))
    return m.select("a", "b", "r", rl.strength_label(F.col("r")).alias("strength"), rl.advice(F.col("r"), F.col("b") == "total").alias("advice"))


def _box_sql(by):
    keys = ", ".join(by)
    return with_sql(FACTS_SQL) + f""",
q AS (SELECT {keys}, CAST(COUNT(total) AS BIGINT) AS n, MIN(total) AS mn, MAX(total) AS mx,
             QUANTILE_CONT(total, 0.25) AS q1, QUANTILE_CONT(total, 0.5) AS med, QUANTILE_CONT(total, 0.75) AS q3
      FROM facts GROUP BY {keys})
SELECT {keys}, n, ROUND(mn, 4) AS min, ROUND(q1, 4) AS q1, ROUND(med, 4) AS median, ROUND(q3, 4) AS q3,
       ROUND(mx, 4) AS max, ROUND(q3 - q1, 4) AS iqr, ROUND(q1 - 1.5 * (q3 - q1), 4) AS lower_fence,
       ROUND(q3 + 1.5 * (q3 - q1), 4) AS upper_fence FROM q"""


@query("box_by_group", _box_sql(["segment"]))
def box_by_group(spark, sf):
    """Five-number summary per group."""
    return rl.box_stats(facts(spark, sf), "total", ["segment"])


@query("box_by_two_groups", _box_sql(["segment", "priority"]))
def box_by_two_groups(spark, sf):
    return rl.box_stats(facts(spark, sf), "total", ["segment", "priority"])


@query("whiskers", with_sql(FACTS_SQL) + """,
q AS (SELECT segment, QUANTILE_CONT(total, 0.25) AS q1, QUANTILE_CONT(total, 0.75) AS q3 FROM facts GROUP BY segment)
SELECT f.id, f.segment, f.total, f.total > q.q3 + 1.5 * (q.q3 - q.q1) AS high
FROM facts f JOIN q ON q.segment = f.segment
WHERE f.total < q.q1 - 1.5 * (q.q3 - q.q1) OR f.total > q.q3 + 1.5 * (q.q3 - q.q1)""")
def whiskers(spark, sf):
    """Rows beyond the 1.5 IQR fences of their group (join back + filter)."""
    from lodestar.operators import profile as pf
    from lodestar.operators import relational as rel
    f = facts(spark, sf)
    q = pf.quantiles_wide(f, "total", [0.25, 0.75], ["q1", "q3"], by=["segment"])
    iqr = F.col("q3") - F.col("q1")
    j = f.join(rel.small_side(q), "segment")  # one row per group
    hi = F.col("total") > F.col("q3") + 1.5 * iqr
    lo = F.col("total") < F.col("q1") - 1.5 * iqr
    return j.where(lo | hi).select("id", "segment", "total", hi.alias("high"))


@query("density_histogram", with_sql(FACTS_SQL) + """,
m AS (SELECT MIN(total) AS lo, MAX(total) AS hi, COUNT(total) AS n FROM facts),
b AS (SELECT CAST(LEAST(FLOOR((total - lo) / ((hi - lo) / 15.0)), 14) AS INTEGER) AS bin FROM facts, m),
c AS (SELECT bin, COUNT(*) AS cnt FROM b GROUP BY bin)
SELECT CAST(g.range AS INTEGER) AS bin, ROUND(lo + (hi - lo) / 15.0 * g.range, 4) AS bin_lo,
       ROUND(lo + (hi - lo) / 15.0 * (g.range + 1), 4) AS bin_hi, CAST(COALESCE(cnt, 0) AS BIGINT) AS count,
       ROUND(COALESCE(cnt, 0) / (n * ((hi - lo) / 15.0)), 10) AS density
FROM range(15) g CROSS JOIN m LEFT JOIN c ON c.bin = g.range""")
def density_histogram(spark, sf):
    """15-bin density histogram."""
    return rl.histogram(facts(spark, sf), "total", 15)


@query("normal_curve", with_sql(FACTS_SQL) + ",\n" + FIT_SQL + """,
m AS (SELECT AVG(residual) AS mu, STDDEV_POP(residual) AS sd, MIN(residual) AS lo, MAX(residual) AS hi FROM res),
g AS (SELECT CAST(range AS BIGINT) AS i, lo + (hi - lo) * CAST(range AS DOUBLE) / 99.0 AS x, mu, sd FROM range(100), m)
SELECT i, ROUND(x, 4) AS x, ROUND(exp(-0.5 * pow((x - mu) / sd, 2)) / (sd * 2.5066282746310002), 12) AS pdf FROM g""")
def normal_curve(spark, sf):
    """Normal reference curve of the residuals (population sd)."""
    return rl.normal_curve(_res(spark, sf), "residual", 100)


@query("residual_summary", with_sql(FACTS_SQL) + ",\n" + FIT_SQL + """
SELECT ROUND(AVG(residual), 4) + 0.0 AS mean, ROUND(STDDEV_POP(residual), 4) + 0.0 AS sd,
       ROUND(MIN(residual), 4) + 0.0 AS min, ROUND(MAX(residual), 4) + 0.0 AS max FROM res""")
def residual_summary(spark, sf):
    """Residual mean, population sd, min, max."""
    return rl.residual_summary(_res(spark, sf))


@query("sigma_band", with_sql(FACTS_SQL) + ",\n" + FIT_SQL + """,
s AS (SELECT STDDEV_POP(residual) AS sd FROM res)
SELECT CAST(COUNT_IF(abs(residual) <= 2.0 * sd) AS BIGINT) AS n_inside,
       CAST(COUNT_IF(NOT abs(residual) <= 2.0 * sd) AS BIGINT) AS n_outside,
       ROUND(COUNT_IF(abs(residual) <= 2.0 * sd) * 100.0 / COUNT(*), 4) AS pct_inside,
       ROUND(2.0 * MAX(sd), 4) AS band_half_width FROM res, s""")
def sigma_band(spark, sf):
    """+-2 sigma residual band and membership."""
    return rl.sigma_band(_res(spark, sf))


@query("heteroscedasticity", with_sql(FACTS_SQL) + ",\n" + FIT_SQL + """
SELECT ROUND(corr(abs(residual), pred), 6) AS r_abs_res_pred, abs(corr(abs(residual), pred)) > 0.3 AS heteroscedastic
FROM res""")
def heteroscedasticity(spark, sf):
    """Heteroscedasticity flag."""
    return rl.heteroscedasticity(_res(spark, sf))
