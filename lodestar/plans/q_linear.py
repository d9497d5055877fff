"""Step 7: the linear family and its analytic intervals (2K, 2L L1/L7-L13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions.stats import sql_t975
from lodestar.operators import linear as lin
from lodestar.operators import models as md
from lodestar.operators import regression as rg
from lodestar.operators import resample as rs
from lodestar.plans import sql_linear as sql
from lodestar.plans.facts import FACTS_SQL, with_sql
from lodestar.plans.q_split import SPLIT_SQL, split_facts
from lodestar.plans.registry import query

X2 = ["n_lines", "qty"]
ALPHAS = [10.0 ** k for k in range(-3, 4)]          # 1e-3 .. 1e3, 7 values
RIDGE_ALPHA = 1.0
LASSO_ALPHA = 10.0
ENET_ALPHA, ENET_L1 = 0.1, 0.5                      # notebook values

BASE = with_sql(FACTS_SQL, SPLIT_SQL) + """,
tr AS (SELECT * FROM split WHERE NOT is_test),
te AS (SELECT * FROM split WHERE is_test),
fit AS (SELECT regr_slope(total, n_lines) AS slope, regr_intercept(total, n_lines) AS intercept,
               regr_r2(total, n_lines) AS r2, regr_count(total, n_lines) AS n, regr_avgx(total, n_lines) AS mx,
               regr_sxx(total, n_lines) AS sxx, regr_syy(total, n_lines) - regr_slope(total, n_lines) * regr_sxy(total, n_lines) AS sse
        FROM tr)"""


def _train_test(spark, sf):
    f = split_facts(spark, sf)
    return f.where(~F.col("is_test")), f.where(F.col("is_test"))


def _fit(train):
    """Simple OLS of total on n_lines plus the interval ingredients, one row."""
    return train.agg(F.regr_slope("total", "n_lines").alias("slope"),
                     F.regr_intercept("total", "n_lines").alias("intercept"),
                     F.regr_r2("total", "n_lines").alias("r2"), F.regr_count("total", "n_lines").alias("n"),
                     F.regr_avgx("total", "n_lines").alias("mx"), F.regr_sxx("total", "n_lines").alias("sxx"),
                     (F.regr_syy("total", "n_lines") - F.regr_slope("total", "n_lines") *
                      F.regr_sxy("total", "n_lines")).alias("sse"))


def _predicted_test(spark, sf):
    train, test = _train_test(spark, sf)
    fit = _fit(train)
    j = test.crossJoin(F.broadcast(fit))
    return j.withColumn("pred", F.col("intercept") + F.col("slope") * F.col("n_lines").cast("double"))


@query("ols_simple", BASE + """
SELECT ROUND(slope, 6) AS slope, ROUND(intercept, 4) AS intercept, ROUND(r2, 8) AS r2, CAST(n AS BIGINT) AS n FROM fit""")
def ols_simple(spark, sf):
    """K1: simple regression in closed form (regr_* aggregates)."""
    train, _ = _train_test(spark, sf)
    return _fit(train).select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                              F.round("r2", 8).alias("r2"), F.col("n").cast("bigint").alias("n"))


METRICS_SQL = """m AS (SELECT COUNT(*) AS n_test, sqrt(AVG(pow(te.total - (intercept + slope * te.n_lines), 2))) AS rmse,
       AVG(abs(te.total - (intercept + slope * te.n_lines))) AS mae,
       1 - SUM(pow(te.total - (intercept + slope * te.n_lines), 2)) / (VAR_POP(te.total) * COUNT(*)) AS r2
       FROM te, fit)"""


@query("ols_metrics", BASE + ",\n" + METRICS_SQL + """
SELECT CAST(n_test AS BIGINT) AS n_test, ROUND(rmse, 4) AS rmse, ROUND(mae, 4) AS mae, ROUND(r2, 8) AS r2 FROM m""")
def ols_metrics(spark, sf):
    """L1: RMSE, MAE, R^2 of the train fit on the test split (one pass)."""
    m = md.point_metrics(_predicted_test(spark, sf), "total", "pred")
    return m.select(F.col("n").cast("bigint").alias("n_test"), F.round("rmse", 4).alias("rmse"),
                    F.round("mae", 4).alias("mae"), F.round("r2", 8).alias("r2"))


GRID_SQL = """g AS (SELECT CAST(range AS BIGINT) AS i, mn + (mxx - mn) * CAST(range AS DOUBLE) / 49.0 AS x
      FROM range(50), (SELECT MIN(CAST(n_lines AS DOUBLE)) AS mn, MAX(CAST(n_lines AS DOUBLE)) AS mxx FROM tr)),
b AS (SELECT i, x, intercept + slope * x AS yh,
             sqrt(sse / n * (1.0 / n + pow(x - mx, 2) / sxx)) AS se_m,
             sqrt(sse / n * (1.0 + 1.0 / n + pow(x - mx, 2) / sxx)) AS se_p, """ + sql_t975("n - 2") + """ AS t
      FROM g, fit)"""


@query("mean_and_prediction_interval", BASE + ",\n" + GRID_SQL + """
SELECT i, ROUND(x, 4) AS x, ROUND(yh, 2) AS y_hat, ROUND(yh - t * se_m, 2) AS ci_lower, ROUND(yh + t * se_m, 2) AS ci_upper,
       ROUND(yh - t * se_p, 2) AS pi_lower, ROUND(yh + t * se_p, 2) AS pi_upper FROM b""")
def mean_and_prediction_interval(spark, sf):
    """Confidence band of the mean and prediction band on a 50-point grid.
    mse = SSE / n as in the reference; t with n - 2 degrees of freedom."""
    train, _ = _train_test(spark, sf)
    fit = _fit(train)
    rng = train.agg(F.min(F.col("n_lines").cast("double")).alias("mn"), F.max(F.col("n_lines").cast("double")).alias("mxx"))
    grid = spark.range(50).withColumnRenamed("id", "i").crossJoin(F.broadcast(rng)) \
        .select("i", (F.col("mn") + (F.col("mxx") - F.col("mn")) * F.col("i").cast("double") / F.lit(49.0)).alias("x"))
    b = md.interval_frame(grid.crossJoin(F.broadcast(fit)), F.col("x"))
    return b.select("i", F.round("x", 4).alias("x"), *[F.round(c, 2).alias(c) for c in
                    ["y_hat", "ci_lower", "ci_upper", "pi_lower", "pi_upper"]])


@query("approx_band", BASE + ",\n" + METRICS_SQL + """
SELECT te.id, te.total, ROUND(intercept + slope * te.n_lines, 2) AS pred,
       ROUND(intercept + slope * te.n_lines - 1.96 * rmse, 2) AS lower, ROUND(intercept + slope * te.n_lines + 1.96 * rmse, 2) AS upper,
       abs(te.total - (intercept + slope * te.n_lines)) <= 1.96 * rmse AS inside
FROM te, fit, m""")
def approx_band(spark, sf):
    """Prediction +- 1.96 RMSE on the test rows."""
    p = _predicted_test(spark, sf)
    rmse = p.agg(F.sqrt(F.avg(F.pow(F.col("total") - F.col("pred"), 2))).alias("__rmse"))
    j = p.crossJoin(F.broadcast(rmse))
    half = F.lit(1.96) * F.col("__rmse")
    return j.select("id", "total", F.round("pred", 2).alias("pred"), F.round(F.col("pred") - half, 2).alias("lower"),
                    F.round(F.col("pred") + half, 2).alias("upper"),
                    (F.abs(F.col("total") - F.col("pred")) <= half).alias("inside"))


@query("interval_width", BASE + """,
b AS (SELECT sqrt(sse / n * (1.0 / n + pow(te.n_lines - mx, 2) / sxx)) AS se_m,
             sqrt(sse / n * (1.0 + 1.0 / n + pow(te.n_lines - mx, 2) / sxx)) AS se_p, """ + sql_t975("n - 2") + """ AS t
      FROM te, fit)
SELECT ROUND(AVG(2 * t * se_m), 4) AS mean_ci_width, ROUND(AVG(2 * t * se_p), 4) AS mean_pi_width,
       ROUND(AVG(2 * t * se_p) / AVG(2 * t * se_m), 6) AS pi_ci_ratio FROM b""")
def interval_width(spark, sf):
    """Mean width of the confidence and prediction intervals on test rows."""
    train, test = _train_test(spark, sf)
    b = md.interval_frame(test.crossJoin(F.broadcast(_fit(train))), F.col("n_lines").cast("double"))
    ci = F.avg(F.col("ci_upper") - F.col("ci_lower"))
    pi = F.avg(F.col("pi_upper") - F.col("pi_lower"))
    return b.agg(F.round(ci, 4).alias("mean_ci_width"), F.round(pi, 4).alias("mean_pi_width"),
                 F.round(pi / ci, 6).alias("pi_ci_ratio"))


@query("overfit_gap", BASE + ",\n" + METRICS_SQL + """
SELECT ROUND(fit.r2, 8) AS r2_train, ROUND(m.r2, 8) AS r2_test,
       ROUND(CASE WHEN fit.r2 <= 0 THEN 0.0 ELSE (fit.r2 - m.r2) / fit.r2 * 100 END, 6) AS gap_pct FROM fit, m""")
def overfit_gap(spark, sf):
    """(R2 train - R2 test) / R2 train * 100, 0 when R2 train <= 0."""
    train, _ = _train_test(spark, sf)
    r2_train = _fit(train).select(F.col("r2").alias("r2_train"))
    m = md.point_metrics(_predicted_test(spark, sf), "total", "pred").select(F.col("r2").alias("r2_test"))
    j = r2_train.crossJoin(m)
    gap = F.when(F.col("r2_train") <= 0, F.lit(0.0)).otherwise(
        (F.col("r2_train") - F.col("r2_test")) / F.col("r2_train") * 100)
    return j.select(F.round("r2_train", 8).alias("r2_train"), F.round("r2_test", 8).alias("r2_test"),
                    F.round(gap, 6).alias("gap_pct"))


# ---------------------------------------------------------------- 2-predictor SQL
STATS2 = """st AS (SELECT COUNT(*) AS n, AVG(CAST(n_lines AS DOUBLE)) AS m1, AVG(qty) AS m2, AVG(total) AS my,
   COVAR_POP(n_lines, n_lines) * COUNT(*) AS s11, COVAR_POP(n_lines, qty) * COUNT(*) AS s12,
   COVAR_POP(qty, qty) * COUNT(*) AS s22, COVAR_POP(n_lines, total) * COUNT(*) AS s1y,
   COVAR_POP(qty, total) * COUNT(*) AS s2y FROM {src})"""


def _ridge_std_sql(alpha: float) -> str:
    """Standardised (population sd) 2-predictor ridge by Cramer's rule."""
    a = repr(float(alpha))
    return f"""z AS (SELECT n, my, s11 / (s11 / n) AS a11, s22 / (s22 / n) AS a22,
               s12 / (sqrt(s11 / n) * sqrt(s22 / n)) AS a12, s1y / sqrt(s11 / n) AS c1, s2y / sqrt(s22 / n) AS c2 FROM st),
r AS (SELECT my AS b0, ((a22 + {a}) * c1 - a12 * c2) / ((a11 + {a}) * (a22 + {a}) - a12 * a12) AS b1,
             ((a11 + {a}) * c2 - a12 * c1) / ((a11 + {a}) * (a22 + {a}) - a12 * a12) AS b2 FROM z)"""


def _coef_frame(spark, names, b0, beta, digits):
    rows = [("intercept", float(round(b0, digits)))] + [(n, float(round(float(b), digits))) for n, b in zip(names, beta)]
    return spark.createDataFrame(rows, "term string, coef double")


def full_design(spark, sf):
    """(train, test, fitted design): two numeric and two one-hot predictors."""
    train, test = _train_test(spark, sf)
    return train, test, rg.fit_design(train, sql.NUMERIC, sql.ONE_HOT, "total")


def moment_cube(spark, sf):
    """(design, test part's moments, {fold: moments}) from one pass over the rows."""
    design = full_design(spark, sf)[2]
    part = F.when(F.col("is_test"), F.lit(-1)).otherwise(rs.hash_fold("id", sql.FOLDS))
    cube = rg.collect_moments(rg.cross_moments(split_facts(spark, sf), design, part), design)
    return design, cube.pop(-1), cube


MULTI_SQL = sql.CUBE + "," + sql.gauss_jordan("ols", "whole", ["g"])


@query("ols_multi", MULTI_SQL + """
SELECT term, ROUND(b / sd, 4) AS coef FROM ols JOIN sd ON sd.i = ols.i
UNION ALL SELECT 'intercept', ROUND(my + SUM(CASE WHEN ols.i = 0 THEN b ELSE -b * mu / sd END), 4)
FROM ols LEFT JOIN sd ON sd.i = ols.i, sc GROUP BY my""")
def ols_multi(spark, sf):
    """K2: multiple OLS on two numeric and two one-hot predictors."""
    train, _, design = full_design(spark, sf)
    return rg.solve_each(rg.cross_moments(train, design, F.lit(0)), design, min_norm=True).select("term", F.round("coef", 4).alias("coef"))


def _std_moments(spark, sf):
    train, _ = _train_test(spark, sf)
    m = lin.moments(train, X2, "total")[None]
    return m.standardise(m.mean[:-1], lin.pop_sd(m))


@query("ridge", BASE + ",\n" + STATS2.format(src="tr") + ",\n" + _ridge_std_sql(RIDGE_ALPHA) + """
SELECT 'intercept' AS term, ROUND(b0, 6) AS coef FROM r
UNION ALL SELECT 'n_lines', ROUND(b1, 6) FROM r UNION ALL SELECT 'qty', ROUND(b2, 6) FROM r""")
def ridge(spark, sf):
    """K3: ridge (alpha 1) on standardised features with unpenalised intercept."""
    b0, beta = lin.solve(_std_moments(spark, sf), RIDGE_ALPHA)
    return _coef_frame(spark, X2, b0, beta, 6)


@query("linear_importance", MULTI_SQL + """
SELECT term, ROUND(b, 6) AS coef, ROUND(abs(b), 6) AS abs_coef,
       CAST(ROW_NUMBER() OVER (ORDER BY abs(b) DESC, term) AS INTEGER) AS rank FROM ols JOIN sd ON sd.i = ols.i""")
def linear_importance(spark, sf):
    """|standardised coefficient| ranking of every predictor (argmax = rank 1)."""
    train, _, design = full_design(spark, sf)
    coef = rg.solve_each(rg.cross_moments(train, design, F.lit(0)), design, min_norm=True).where("term <> 'intercept'")
    size = F.abs("std_coef")
    rank = F.row_number().over(Window.orderBy(size.desc(), F.col("term")))          # one row per predictor
    return coef.select("term", F.round("std_coef", 6).alias("coef"), F.round(size, 6).alias("abs_coef"), rank.alias("rank"))


@query("trend_top_variable", BASE + ",\n" + STATS2.format(src="tr") + ",\n" + _ridge_std_sql(0.0) + """,
top AS (SELECT CASE WHEN abs(b1) >= abs(b2) THEN 'n_lines' ELSE 'qty' END AS variable FROM r),
xy AS (SELECT variable, CASE WHEN variable = 'n_lines' THEN CAST(n_lines AS DOUBLE) ELSE qty END AS x, total FROM facts, top)
SELECT variable, ROUND(regr_slope(total, x), 6) AS slope, ROUND(regr_intercept(total, x), 4) AS intercept,
       ROUND(regr_r2(total, x), 8) AS r2 FROM xy GROUP BY variable""")
def trend_top_variable(spark, sf):
    """Simple trend of the target on the most important variable over
    train and test together."""
    _, beta = lin.solve(_std_moments(spark, sf), 0.0)
    top = X2[0] if abs(beta[0]) >= abs(beta[1]) else X2[1]
    f = split_facts(spark, sf)
    x = F.col(top).cast("double")
    return f.agg(F.round(F.regr_slope("total", x), 6).alias("slope"), F.round(F.regr_intercept("total", x), 4)
                 .alias("intercept"), F.round(F.regr_r2("total", x), 8).alias("r2")) \
        .select(F.lit(top).alias("variable"), "slope", "intercept", "r2")


def _alpha_grid_sql():
    fold = f"CAST({rs_sql_fold()} AS INTEGER)"
    sums = ("COUNT(*) AS n, SUM(x1) AS sx1, SUM(x2) AS sx2, SUM(y) AS sy, SUM(x1 * x1) AS s11, SUM(x1 * x2) AS s12, "
            "SUM(x2 * x2) AS s22, SUM(x1 * y) AS s1y, SUM(x2 * y) AS s2y, SUM(y * y) AS syy")
    tot = ", ".join(f"SUM({c}) AS {c}" for c in ["n", "sx1", "sx2", "sy", "s11", "s12", "s22", "s1y", "s2y", "syy"])

    def z(p):  # z-space statistics of a raw-sum set with prefix p
        return (f"({p}sx1 / {p}n - mu1) / sd1 AS {p}z1, ({p}sx2 / {p}n - mu2) / sd2 AS {p}z2, {p}sy / {p}n AS {p}ym, "
                f"({p}s11 - {p}sx1 * {p}sx1 / {p}n) / (sd1 * sd1) AS {p}a11, ({p}s22 - {p}sx2 * {p}sx2 / {p}n) / (sd2 * sd2) AS {p}a22, "
                f"({p}s12 - {p}sx1 * {p}sx2 / {p}n) / (sd1 * sd2) AS {p}a12, ({p}s1y - {p}sx1 * {p}sy / {p}n) / sd1 AS {p}c1, "
                f"({p}s2y - {p}sx2 * {p}sy / {p}n) / sd2 AS {p}c2, {p}syy - {p}sy * {p}sy / {p}n AS {p}yy, {p}n AS {p}nn")
    alphas = " UNION ALL ".join(f"SELECT CAST({a!r} AS DOUBLE) AS alpha" for a in ALPHAS)
    return BASE + f""",
d AS (SELECT {fold} AS fold, CAST(n_lines AS DOUBLE) AS x1, qty AS x2, total AS y FROM tr),
sc AS (SELECT AVG(x1) AS mu1, AVG(x2) AS mu2, STDDEV_POP(x1) AS sd1, STDDEV_POP(x2) AS sd2 FROM d),
fs AS (SELECT fold, {sums} FROM d GROUP BY fold),
tt AS (SELECT {tot} FROM fs),
pr AS (SELECT fs.fold, fs.n AS hn, fs.sx1 AS hsx1, fs.sx2 AS hsx2, fs.sy AS hsy, fs.s11 AS hs11, fs.s12 AS hs12,
              fs.s22 AS hs22, fs.s1y AS hs1y, fs.s2y AS hs2y, fs.syy AS hsyy,
              tt.n - fs.n AS tn, tt.sx1 - fs.sx1 AS tsx1, tt.sx2 - fs.sx2 AS tsx2, tt.sy - fs.sy AS tsy,
              tt.s11 - fs.s11 AS ts11, tt.s12 - fs.s12 AS ts12, tt.s22 - fs.s22 AS ts22, tt.s1y - fs.s1y AS ts1y,
              tt.s2y - fs.s2y AS ts2y, tt.syy - fs.syy AS tsyy, mu1, mu2, sd1, sd2 FROM fs, tt, sc),
zz AS (SELECT fold, {z('h')}, {z('t')} FROM pr),
al AS ({alphas}),
co AS (SELECT alpha, zz.*,
          ((ta22 + alpha) * tc1 - ta12 * tc2) / ((ta11 + alpha) * (ta22 + alpha) - ta12 * ta12) AS b1,
          ((ta11 + alpha) * tc2 - ta12 * tc1) / ((ta11 + alpha) * (ta22 + alpha) - ta12 * ta12) AS b2 FROM zz, al),
sc2 AS (SELECT alpha, fold, 1 - (hyy - 2 * (b1 * hc1 + b2 * hc2) + (b1 * b1 * ha11 + 2 * b1 * b2 * ha12 + b2 * b2 * ha22)
             + hnn * pow(hym - (tym - b1 * tz1 - b2 * tz2) - b1 * hz1 - b2 * hz2, 2)) / hyy AS r2 FROM co),
mr AS (SELECT alpha, AVG(r2) AS mean_r2 FROM sc2 GROUP BY alpha)"""


def _alpha_grid_select():
    return _alpha_grid_sql() + """
SELECT alpha, ROUND(mean_r2, 8) AS mean_r2,
       alpha = (SELECT alpha FROM mr ORDER BY mean_r2 DESC, alpha LIMIT 1) AS is_best FROM mr"""


def _ridge_cv_sql():
    return _alpha_grid_sql() + """,
best AS (SELECT alpha FROM mr ORDER BY mean_r2 DESC, alpha LIMIT 1),
""" + STATS2.format(src="tr") + """,
z AS (SELECT n, my, s11 / (s11 / n) AS a11, s22 / (s22 / n) AS a22,
             s12 / (sqrt(s11 / n) * sqrt(s22 / n)) AS a12, s1y / sqrt(s11 / n) AS c1, s2y / sqrt(s22 / n) AS c2 FROM st),
r AS (SELECT alpha, my AS b0, ((a22 + alpha) * c1 - a12 * c2) / ((a11 + alpha) * (a22 + alpha) - a12 * a12) AS b1,
             ((a11 + alpha) * c2 - a12 * c1) / ((a11 + alpha) * (a22 + alpha) - a12 * a12) AS b2 FROM z, best)
SELECT 'intercept' AS term, alpha, ROUND(b0, 6) AS coef FROM r
UNION ALL SELECT 'n_lines', alpha, ROUND(b1, 6) FROM r UNION ALL SELECT 'qty', alpha, ROUND(b2, 6) FROM r"""


def rs_sql_fold():
    from lodestar.functions.hashing import sql_hash_u32
    return f"{sql_hash_u32('id', chr(39) + 'fold42' + chr(39))} % 5"


@query("alpha_grid", _alpha_grid_select())
def alpha_grid(spark, sf):
    """K6: 7 alphas x 5 shuffled folds of ridge from ONE aggregation pass over
    the training rows (per-fold co-moments; training = merge of the others)."""
    train, _ = _train_test(spark, sf)
    folds = lin.moments(train.withColumn("fold", rs.hash_fold("id", 5)), X2, "total", by="fold")
    whole = lin.merge_all([folds[k] for k in sorted(folds)])
    res = lin.alpha_grid(folds, ALPHAS, standardise_with=whole)
    best = max(res, key=lambda r: (r[1], -r[0]))[0]
    rows = [(a, float(round(m, 8)), a == best) for a, m, _ in res]
    return spark.createDataFrame(rows, "alpha double, mean_r2 double, is_best boolean")


def _penalised_sql(alpha: float, l1_ratio: float) -> str:
    params = f"SELECT 0 AS g, CAST({alpha * l1_ratio!r} AS DOUBLE) AS l1, CAST({alpha * (1 - l1_ratio)!r} AS DOUBLE) AS l2"
    return sql.CUBE + "," + sql.coordinate_descent("fit", "whole", params) + f""",
full_fit AS (SELECT i, -b AS b FROM fit UNION ALL SELECT {sql.P + 1}, 1.0),
sse AS (SELECT SUM(a.b * b.b * m.v) AS v FROM full_fit a, full_fit b JOIN cube m ON m.g = -1 AND m.i = a.i AND m.j = b.i),
te_y AS (SELECT MAX(v) FILTER (i = 0 AND j = 0) AS n, MAX(v) FILTER (i = 0 AND j = {sql.P + 1}) AS sy,
                MAX(v) FILTER (i = {sql.P + 1} AND j = {sql.P + 1}) AS syy FROM cube WHERE g = -1)
SELECT 'intercept' AS term, ROUND(my, 6) AS value FROM sc
UNION ALL SELECT term, ROUND(b, 6) FROM fit JOIN sd ON sd.i = fit.i
UNION ALL SELECT 'r2_test', ROUND(1 - sse.v / (syy - sy * sy / n), 6) FROM sse, te_y"""


def _penalised(spark, sf, alpha: float, l1_ratio: float):
    """Coefficients on standardised predictors and the R2 of the test part, both
    from the moment cube: no pass per iteration."""
    design, test, folds = moment_cube(spark, sf)
    whole = lin.merge_all([folds[k] for k in sorted(folds)])
    mu, sd = whole.mean[:-1], lin.pop_sd(whole)
    b0, beta = lin.coordinate_descent(whole.standardise(mu, sd), alpha, l1_ratio)
    rows = [("intercept", b0), *zip(design.names, beta), ("r2_test", lin.r2(test.standardise(mu, sd), b0, beta))]
    return spark.createDataFrame([(t, float(round(v, 6))) for t, v in rows], "term string, value double")


@query("lasso", _penalised_sql(LASSO_ALPHA, 1.0))
def lasso(spark, sf):
    """K4: lasso on standardised features (co-moments + coordinate descent)."""
    return _penalised(spark, sf, LASSO_ALPHA, 1.0)


@query("elastic_net", _penalised_sql(ENET_ALPHA, ENET_L1))
def elastic_net(spark, sf):
    """K5: elastic net (alpha 0.1, l1_ratio 0.5) on the co-moments, the
    reference's objective directly (no conversion to Spark ML's parameterisation)."""
    return _penalised(spark, sf, ENET_ALPHA, ENET_L1)


@query("lasso_alpha_grid", sql.CUBE + "," + sql.lasso_grid("lg", ALPHAS) + """
SELECT alpha, ROUND(mean_r2, 8) AS mean_r2,
       alpha = (SELECT alpha FROM lg ORDER BY mean_r2 DESC, alpha LIMIT 1) AS is_best FROM lg""")
def lasso_alpha_grid(spark, sf):
    """K6: the lasso over 7 alphas x 5 shuffled folds on all predictors, from
    the same one-pass cube as the fits."""
    folds = moment_cube(spark, sf)[2]
    whole = lin.merge_all([folds[k] for k in sorted(folds)])
    res = lin.alpha_grid(folds, ALPHAS, standardise_with=whole, fit=lin.coordinate_descent)
    best = max(res, key=lambda r: (r[1], -r[0]))[0]
    return spark.createDataFrame([(a, float(round(m, 8)), a == best) for a, m, _ in res], "alpha double, mean_r2 double, is_best boolean")


@query("ridge_cv", _ridge_cv_sql())
def ridge_cv(spark, sf):
    """K3 + K6: ridge with the alpha the 5-fold grid picks (first maximum of
    the mean held-out R^2), fitted on the standardised training set -- the
    grid and the fit share the one-pass fold moments."""
    train, _ = _train_test(spark, sf)
    folds = lin.moments(train.withColumn("fold", rs.hash_fold("id", 5)), X2, "total", by="fold")
    whole = lin.merge_all([folds[k] for k in sorted(folds)])
    res = lin.alpha_grid(folds, ALPHAS, standardise_with=whole)
    best = max(res, key=lambda r: (r[1], -r[0]))[0]
    b0, beta = lin.solve(whole.standardise(whole.mean[:-1], lin.pop_sd(whole)), best)
    rows = [("intercept", best, float(round(b0, 6)))] + [(n, best, float(round(b, 6))) for n, b in zip(X2, beta)]
    return spark.createDataFrame(rows, "term string, alpha double, coef double")
