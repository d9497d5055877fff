"""Step 8: resampling inference -- Poisson bootstrap and cross-validated
t-intervals (2I I4-I5, 2L L2-L6, L12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.hashing import sql_hash_u32, sql_poisson1_weight, sql_replicate_uniform
from lodestar.functions.stats import t_ppf
from lodestar.operators import inference as inf
from lodestar.operators import regression as rg
from lodestar.plans import sql_linear as sql
from lodestar.plans.q_linear import BASE, METRICS_SQL, MULTI_SQL, _predicted_test, _train_test, full_design
from lodestar.plans.registry import query

B_METRICS = 1000     # reference: 1000 reps for metric intervals
B_COEF = 1000        # 1000 for the simple-regression coefficients
B_MULTI = 500        # 500 for the multiple-regression coefficients
K_FOLDS = 5          # shuffled folds (advanced pipeline) and the multiple regression
K_SIMPLE = 3         # the reference cross-validates the simple regression with 3 contiguous folds

W_SQL = """w AS (SELECT * FROM (SELECT *, {pois} AS w FROM (SELECT s.*, r.range AS rep, {u} AS u
                     FROM (SELECT *, {h} AS h FROM {src}) s, range({B}) r)) WHERE w > 0)"""


def _w(src, key, B):
    return W_SQL.format(src=src, B=B, h=sql_hash_u32(key, "'boot'"), u=sql_replicate_uniform("s.h", "r.range"),
                        pois=sql_poisson1_weight("u"))


@query("bootstrap_metrics_ci", BASE + ",\n" + METRICS_SQL + """,
p AS (SELECT te.id, te.total AS y, intercept + slope * te.n_lines AS pred FROM te, fit),
""" + _w("p", "id", B_METRICS) + """,
per AS (SELECT rep, SUM(w) AS sw, SUM(w * (y - pred) * (y - pred)) AS se, SUM(w * abs(y - pred)) AS sa,
               SUM(w * y) AS sy, SUM(w * y * y) AS syy FROM w GROUP BY rep),
st AS (SELECT sqrt(se / sw) AS rmse, sa / sw AS mae, 1 - se / (syy - sy * sy / sw) AS r2 FROM per),
ci AS (SELECT QUANTILE_CONT(rmse, 0.025) AS rl, QUANTILE_CONT(rmse, 0.975) AS ru, QUANTILE_CONT(mae, 0.025) AS ml,
              QUANTILE_CONT(mae, 0.975) AS mu, QUANTILE_CONT(r2, 0.025) AS ql, QUANTILE_CONT(r2, 0.975) AS qu FROM st)
SELECT 'Simple OLS' AS modelo, ROUND(m.rmse, 2) AS rmse, ROUND(rl, 2) AS rmse_ci_lower, ROUND(ru, 2) AS rmse_ci_upper,
       ROUND(m.mae, 2) AS mae, ROUND(ml, 2) AS mae_ci_lower, ROUND(mu, 2) AS mae_ci_upper,
       ROUND(m.r2, 6) AS r2, ROUND(ql, 6) AS r2_ci_lower, ROUND(qu, 6) AS r2_ci_upper FROM m, ci""")
def bootstrap_metrics_ci(spark, sf):
    """L2/I4: test RMSE, MAE, R^2 with 95 % Poisson-bootstrap intervals."""
    p = _predicted_test(spark, sf).select("id", F.col("total").alias("y"), "pred")
    return inf.metrics_with_ci(p, "id", "y", "pred", B_METRICS, "Simple OLS")


@query("bootstrap_coef_ci", BASE + """,
fullfit AS (SELECT regr_intercept(total, n_lines) AS b0, regr_slope(total, n_lines) AS b1 FROM tr),
src AS (SELECT id, CAST(n_lines AS DOUBLE) AS x, total AS y FROM tr),
""" + _w("src", "id", B_COEF) + """,
per AS (SELECT rep, SUM(w) AS sw, SUM(w * x) AS sx, SUM(w * y) AS sy, SUM(w * x * x) AS sxx, SUM(w * x * y) AS sxy
        FROM w GROUP BY rep),
cf AS (SELECT (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope, sy / sw - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx / sw AS intercept FROM per)
SELECT 'intercept' AS term, ROUND(MAX(fullfit.b0), 4) AS value, ROUND(QUANTILE_CONT(intercept, 0.025), 4) AS ci_lower,
       ROUND(QUANTILE_CONT(intercept, 0.975), 4) AS ci_upper FROM cf, fullfit
UNION ALL
SELECT 'slope', ROUND(MAX(fullfit.b1), 4), ROUND(QUANTILE_CONT(slope, 0.025), 4), ROUND(QUANTILE_CONT(slope, 0.975), 4) FROM cf, fullfit""")
def bootstrap_coef_ci(spark, sf):
    """Percentile intervals of intercept and slope, one weighted pass."""
    train, _ = _train_test(spark, sf)
    return inf.simple_coef_ci(train.select("id", F.col("n_lines").cast("double").alias("x"),
                                           F.col("total").alias("y")), "id", B_COEF)


def _multi_sql():
    mean = lambda t, k: f"""{t}_c AS (SELECT o.{k}, term, b / sd AS v FROM {t} o JOIN sd ON sd.i = o.i
        UNION ALL SELECT o.{k}, 'intercept', my + SUM(CASE WHEN o.i = 0 THEN b ELSE -b * mu / sd END)
        FROM {t} o LEFT JOIN sd ON sd.i = o.i, sc GROUP BY o.{k}, my)"""  # noqa: E731
    return MULTI_SQL + f""",
zt AS (SELECT * FROM z WHERE NOT is_test),
{_w("zt", "id", B_MULTI)},{sql.long_moments("rm", "rep", "w", "w * ")},{sql.gauss_jordan("ro", "rm", ["rep"])},
{mean("ols", "g")},
{mean("ro", "rep")},
ci AS (SELECT term, QUANTILE_CONT(v, 0.025) AS lo, QUANTILE_CONT(v, 0.975) AS hi FROM ro_c GROUP BY term)
SELECT f.term, ROUND(f.v, 4) AS value, ROUND(lo, 4) AS ci_lower, ROUND(hi, 4) AS ci_upper,
       NOT (lo <= 0 AND hi >= 0) AS significant FROM ols_c f JOIN ci ON ci.term = f.term"""


@query("bootstrap_multi_coef", _multi_sql())
def bootstrap_multi_coef(spark, sf):
    """Coefficient intervals of the multiple regression on two numeric
    and two one-hot predictors, refitted on every replicate (weighted
    co-moments per replicate, solved where they land), with significance =
    interval excludes 0."""
    train, _, design = full_design(spark, sf)
    out = rg.coefficient_intervals(train, design, "id", B_MULTI)
    return out.select("term", *[F.round(c, 4).alias(c) for c in ("value", "ci_lower", "ci_upper")], "significant")


def _cv_sql(fold_expr: str, sd_fn: str, k: int) -> str:
    t = t_ppf(0.975, k - 1)
    return BASE + f""",
d AS (SELECT id, {fold_expr} AS fold, CAST(n_lines AS DOUBLE) AS x, total AS y FROM tr),
fs AS (SELECT fold, COUNT(*) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(x * y) AS sxy FROM d GROUP BY fold),
tt AS (SELECT SUM(n) AS n, SUM(sx) AS sx, SUM(sy) AS sy, SUM(sxx) AS sxx, SUM(sxy) AS sxy FROM fs),
tr2 AS (SELECT fs.fold, tt.n - fs.n AS n, tt.sx - fs.sx AS sx, tt.sy - fs.sy AS sy, tt.sxx - fs.sxx AS sxx,
               tt.sxy - fs.sxy AS sxy FROM fs, tt),
co AS (SELECT fold, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1,
              sy / n - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx / n AS b0 FROM tr2),
pm AS (SELECT d.fold, 1 - SUM(pow(y - b0 - b1 * x, 2)) / (VAR_POP(y) * COUNT(*)) AS r2,
              sqrt(AVG(pow(y - b0 - b1 * x, 2))) AS rmse, AVG(abs(y - b0 - b1 * x)) AS mae
       FROM d JOIN co ON co.fold = d.fold GROUP BY d.fold),
lg AS (SELECT 'R2' AS metric, r2 AS v FROM pm UNION ALL SELECT 'Root Mean Squared Error', rmse FROM pm
       UNION ALL SELECT 'Mean Absolute Error', mae FROM pm),
ag AS (SELECT metric, AVG(v) AS mean, {sd_fn}(v) AS sd, COUNT(*) AS k FROM lg GROUP BY metric)
SELECT metric, {_r('mean')} AS mean, {_r('sd')} AS std,
       {_r(f'mean - {t!r} * sd / sqrt(k)')} AS ci_lower, {_r(f'mean + {t!r} * sd / sqrt(k)')} AS ci_upper FROM ag"""


def _r(e: str) -> str:
    return f"CASE WHEN metric = 'R2' THEN ROUND({e}, 6) ELSE ROUND({e}, 2) END"


@query("cv_interval_pop", _cv_sql(f"CAST(NTILE({K_SIMPLE}) OVER (ORDER BY id) - 1 AS INTEGER)", "STDDEV_POP", K_SIMPLE))
def cv_interval_pop(spark, sf):
    """Contiguous 3-fold CV of the simple regression (as the
    reference); t-interval (2 df) with the population sd of the fold scores."""
    train, _ = _train_test(spark, sf)
    return inf.cv_interval(train, "id", K_SIMPLE, contiguous=True, sample_sd=False)


@query("cv_interval_sample", _cv_sql(f"CAST({sql_hash_u32('id', chr(39) + 'fold42' + chr(39))} % 5 AS INTEGER)",
                                     "STDDEV_SAMP", K_FOLDS))
def cv_interval_sample(spark, sf):
    """Shuffled 5-fold CV; t-interval with the sample sd."""
    train, _ = _train_test(spark, sf)
    return inf.cv_interval(train, "id", K_FOLDS, contiguous=False, sample_sd=True)


@query("normality_jb", BASE + """,
r AS (SELECT tr.total - (intercept + slope * tr.n_lines) AS e FROM tr, fit),
mu AS (SELECT AVG(e) AS m, COUNT(*) AS n FROM r),
cm AS (SELECT MAX(n) AS n, AVG(pow(e - m, 2)) AS m2, AVG(pow(e - m, 3)) AS m3, AVG(pow(e - m, 4)) AS m4 FROM r, mu),
jb AS (SELECT n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS k FROM cm)
SELECT CAST(n AS BIGINT) AS n, ROUND(s, 6) AS skewness, ROUND(k, 6) AS excess_kurtosis,
       ROUND(n / 6.0 * (s * s + k * k / 4.0), 4) AS jb, ROUND(exp(-(n / 6.0 * (s * s + k * k / 4.0)) / 2.0), 10) AS p_value,
       exp(-(n / 6.0 * (s * s + k * k / 4.0)) / 2.0) > 0.05 AS normal FROM jb""")
def normality_jb(spark, sf):
    """Jarque-Bera normality of the training residuals (chi-square 2 df)."""
    train, _ = _train_test(spark, sf)
    return inf.jarque_bera(train, "total", "n_lines")
