"""Step 10: model records and reports (L13, L15-L19, C5, A9) with SQL
oracles, and the tree pipeline (K7-K13, I6, L14, L20), checked on rows.

The oracle-checked reports stack deterministic records: two simple
regressions (type Baseline) and a two-predictor regression with 5-fold CV
(type Avanzado).  The tree queries fit Spark ML ensembles: their numbers are
not SQL-expressible, so they get no oracle entry.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodestar.functions.features import clip
from lodestar.functions.hashing import hash_u32, replicate_uniform, sql_hash_u32, sql_replicate_uniform
from lodestar.functions.stats import t_ppf
from lodestar.operators import inference as inf
from lodestar.operators import regression as rg
from lodestar.operators import reports as rp
from lodestar.operators import resample as rs
from lodestar.operators import transform as tf
from lodestar.operators import trees as tr
from lodestar.operators.models import r_squared
from lodestar.plans import sql_linear as sql
from lodestar.plans.facts import FACTS_SQL, facts, with_sql
from lodestar.plans.q_linear import ALPHAS, ENET_ALPHA, ENET_L1, MULTI_SQL, full_design
from lodestar.plans.q_resample import _w
from lodestar.plans.q_split import SPLIT_SQL, split_facts
from lodestar.plans.registry import query
from lodestar.session import scratch_path
from lodestar.sources.tables import read_table

K = 5
T4 = t_ppf(0.975, K - 1)
SUM_COLS = ["sw", "sx1", "sx2", "sy", "s11", "s12", "s22", "s1y", "s2y"]

# ---- deterministic linear records ------------------------------------------


def _xy(spark, sf):
    return split_facts(spark, sf).select("id", F.col("n_lines").cast("double").alias("x1"), F.col("qty").alias("x2"),
                                         F.col("total").alias("y"), "is_test")


def _test_metrics(pred, name):
    e = F.col("y") - F.col("pred")
    return pred.agg(r_squared("y", e).alias("r2_test"),
                    F.sqrt(F.avg(e * e)).alias("rmse_test"), F.avg(F.abs(e)).alias("mae_test")) \
        .select(F.lit(name).alias("modelo"), "*")


def linear_records(spark, sf):
    """Test metrics of three linear models plus the CV summary of the
    two-predictor one: every fit is an aggregation (closed form), the fold
    fits come from per-fold sums (train = total - fold), nothing is collected."""
    d = _xy(spark, sf)
    train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    recs = []
    for name, x in (("Simple OLS (n_lines)", "x1"), ("Simple OLS (qty)", "x2")):
        fit = train.agg(F.regr_slope("y", x).alias("b1"), F.regr_intercept("y", x).alias("b0"))
        p = test.crossJoin(F.broadcast(fit)).withColumn("pred", F.col("b0") + F.col("b1") * F.col(x))
        recs.append(_test_metrics(p, name))
    co = inf._two_predictor_coefs(train.agg(*inf._weighted_sums(train, F.lit(1.0))))
    yhat = F.col("b0") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2")
    multi = _test_metrics(test.crossJoin(F.broadcast(co)).withColumn("pred", yhat), "Multiple OLS")
    folds = train.withColumn("fold", rs.hash_fold("id", K))
    fs = folds.groupBy("fold").agg(*inf._weighted_sums(folds, F.lit(1.0)))          # K rows
    tot = fs.agg(*[F.sum(c).alias(f"t_{c}") for c in SUM_COLS])
    trn = fs.crossJoin(tot).select("fold", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in SUM_COLS])
    cof = inf._two_predictor_coefs(trn)
    e = F.col("y") - yhat
    pf = folds.join(F.broadcast(cof), "fold").groupBy("fold").agg(
        r_squared("y", e).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"))
    aggs = []
    for m in ("r2", "rmse"):
        half = F.lit(T4) * F.stddev_samp(m) / F.sqrt(F.count(F.lit(1)))
        aggs += [F.avg(m).alias(f"{m}_cv_mean"), (F.avg(m) - half).alias(f"{m}_cv_ci_lower"),
                 (F.avg(m) + half).alias(f"{m}_cv_ci_upper")]
    aggs.append(F.stddev_samp("r2").alias("r2_cv_std"))
    cv = pf.agg(*aggs).select(F.lit("Multiple OLS").alias("modelo"), "*")
    baselines = rp.stack(recs)
    return rp.comparison_table(cv, multi, baselines.drop("tipo"))


_SUMS = ", ".join([f"SUM({w}) AS {n}" for w, n in [
    ("1.0", "sw"), ("x1", "sx1"), ("x2", "sx2"), ("y", "sy"), ("x1 * x1", "s11"), ("x1 * x2", "s12"),
    ("x2 * x2", "s22"), ("x1 * y", "s1y"), ("x2 * y", "s2y")]])
_SOLVE = """(SELECT {k}sy / sw - b1 * sx1 / sw - b2 * sx2 / sw AS b0, b1, b2 FROM (
    SELECT {k}sw, sx1, sx2, sy, ((s22 - sx2 * sx2 / sw) * (s1y - sx1 * sy / sw) - (s12 - sx1 * sx2 / sw) * (s2y - sx2 * sy / sw))
             / ((s11 - sx1 * sx1 / sw) * (s22 - sx2 * sx2 / sw) - (s12 - sx1 * sx2 / sw) * (s12 - sx1 * sx2 / sw)) AS b1,
           ((s11 - sx1 * sx1 / sw) * (s2y - sx2 * sy / sw) - (s12 - sx1 * sx2 / sw) * (s1y - sx1 * sy / sw))
             / ((s11 - sx1 * sx1 / sw) * (s22 - sx2 * sx2 / sw) - (s12 - sx1 * sx2 / sw) * (s12 - sx1 * sx2 / sw)) AS b2
    FROM {src}))"""

CMP_SQL = with_sql(FACTS_SQL, SPLIT_SQL) + f""",
s AS (SELECT id, CAST(n_lines AS DOUBLE) AS x1, qty AS x2, total AS y, is_test FROM split),
tr AS (SELECT * FROM s WHERE NOT is_test), te AS (SELECT * FROM s WHERE is_test),
f1 AS (SELECT regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS b0 FROM tr),
f2 AS (SELECT regr_slope(y, x2) AS b1, regr_intercept(y, x2) AS b0 FROM tr),
mc AS {_SOLVE.format(k='', src=f'(SELECT {_SUMS} FROM tr)')},
p AS (SELECT 'Simple OLS (n_lines)' AS modelo, te.y, f1.b0 + f1.b1 * te.x1 AS pred FROM te, f1
      UNION ALL SELECT 'Simple OLS (qty)', te.y, f2.b0 + f2.b1 * te.x2 FROM te, f2
      UNION ALL SELECT 'Multiple OLS', te.y, mc.b0 + mc.b1 * te.x1 + mc.b2 * te.x2 FROM te, mc),
tm AS (SELECT modelo, 1 - SUM(pow(y - pred, 2)) / (VAR_POP(y) * COUNT(*)) AS r2_test,
              sqrt(AVG(pow(y - pred, 2))) AS rmse_test, AVG(abs(y - pred)) AS mae_test FROM p GROUP BY modelo),
d AS (SELECT *, CAST({sql_hash_u32('id', "'fold42'")} % {K} AS INTEGER) AS fold FROM tr),
fs AS (SELECT fold, {_SUMS} FROM d GROUP BY fold),
tt AS (SELECT {', '.join(f'SUM({c}) AS t_{c}' for c in SUM_COLS)} FROM fs),
trn AS (SELECT fold, {', '.join(f't_{c} - {c} AS {c}' for c in SUM_COLS)} FROM fs, tt),
cof AS {_SOLVE.format(k='fold, ', src='trn')},
pf AS (SELECT d.fold, 1 - SUM(pow(y - (b0 + b1 * x1 + b2 * x2), 2)) / (VAR_POP(y) * COUNT(*)) AS r2,
              sqrt(AVG(pow(y - (b0 + b1 * x1 + b2 * x2), 2))) AS rmse FROM d JOIN cof ON cof.fold = d.fold GROUP BY d.fold),
cv AS (SELECT 'Multiple OLS' AS modelo, AVG(r2) AS r2_cv_mean, STDDEV_SAMP(r2) AS r2_cv_std,
              AVG(r2) - {T4!r} * STDDEV_SAMP(r2) / sqrt(COUNT(*)) AS r2_cv_ci_lower,
              AVG(r2) + {T4!r} * STDDEV_SAMP(r2) / sqrt(COUNT(*)) AS r2_cv_ci_upper, AVG(rmse) AS rmse_cv_mean,
              AVG(rmse) - {T4!r} * STDDEV_SAMP(rmse) / sqrt(COUNT(*)) AS rmse_cv_ci_lower,
              AVG(rmse) + {T4!r} * STDDEV_SAMP(rmse) / sqrt(COUNT(*)) AS rmse_cv_ci_upper FROM pf),
cmp AS (SELECT tm.modelo, CASE WHEN tm.modelo = 'Multiple OLS' THEN 'Avanzado' ELSE 'Baseline' END AS tipo,
               r2_cv_mean, r2_cv_std, r2_cv_ci_lower, r2_cv_ci_upper, rmse_cv_mean, rmse_cv_ci_lower, rmse_cv_ci_upper,
               r2_test, rmse_test, mae_test FROM tm LEFT JOIN cv ON cv.modelo = tm.modelo),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tipo ORDER BY r2_test DESC NULLS LAST, modelo) AS rk,
                COUNT(*) OVER (PARTITION BY tipo) AS n_models FROM cmp)
"""


B_RANK = 1000        # reference: 1000 reps for the metric intervals of baseline models


def _rank_sql() -> str:
    """Records of the five linear models: coefficients in z-space, predictions
    and replicate sums of all of them at once."""
    ridge = f"""SELECT w.g, w.i, w.j, v + CASE WHEN i = j AND i BETWEEN 1 AND {sql.P} THEN alpha ELSE 0 END AS v
        FROM whole w, (SELECT alpha FROM rg ORDER BY mean_r2 DESC, alpha LIMIT 1)"""
    lasso = "SELECT 0 AS g, alpha AS l1, 0.0 AS l2 FROM (SELECT alpha FROM lg ORDER BY mean_r2 DESC, alpha LIMIT 1)"
    enet = f"SELECT 0 AS g, CAST({ENET_ALPHA * ENET_L1!r} AS DOUBLE) AS l1, CAST({ENET_ALPHA * (1 - ENET_L1)!r} AS DOUBLE) AS l2"
    coefs = " UNION ALL ".join([
        f"SELECT 0 AS m, 1 AS i, c.v / d.v AS b FROM whole c, whole d WHERE c.i = 1 AND c.j = {sql.P + 1} AND d.i = 1 AND d.j = 1",
        "SELECT 1, i, b FROM ols", "SELECT 2, i, b FROM rf", "SELECT 3, i, b FROM lf", "SELECT 4, i, b FROM ef"])
    n, z = len(rg.FAMILY), ", ".join(f"z{i}" for i in range(sql.P + 1))
    sums = ", ".join(f"SUM(w * e{m} * e{m}) AS se{m}, SUM(w * abs(e{m})) AS sa{m}" for m in range(n))
    point = ", ".join(f"SUM(e{m} * e{m}) AS se{m}, SUM(abs(e{m})) AS sa{m}" for m in range(n))
    long = " UNION ALL ".join(f"SELECT rep, '{name}' AS modelo, 1 - se{m} / (syy - sy * sy / sw) AS r2, sqrt(se{m} / sw) AS rmse, "
                              f"sa{m} / sw AS mae FROM per" for m, name in enumerate(rg.FAMILY))
    ci = ", ".join(f"MAX({c}) FILTER (rep < 0) AS {c}, QUANTILE_CONT({c}, 0.025) FILTER (rep >= 0) AS {c}_ci_lower, "
                   f"QUANTILE_CONT({c}, 0.975) FILTER (rep >= 0) AS {c}_ci_upper" for c in ("r2", "rmse", "mae"))
    return MULTI_SQL + "," + sql.ridge_grid("rg", ALPHAS) + "," + sql.lasso_grid("lg", ALPHAS) + f""",
rm_ridge AS MATERIALIZED ({ridge}),""" + sql.gauss_jordan("rf", "rm_ridge", ["g"]) + "," + \
        sql.coordinate_descent("lf", "whole", lasso) + "," + sql.coordinate_descent("ef", "whole", enet) + f""",
co AS MATERIALIZED (SELECT m, LIST(COALESCE(b, 0.0) ORDER BY i) AS b FROM
   (SELECT k.m, k.i, c.b FROM (SELECT m, i FROM range({n}) a(m), range({sql.P + 1}) r(i)) k LEFT JOIN ({coefs}) c ON c.m = k.m AND c.i = k.i) GROUP BY m),
bm AS (SELECT {", ".join(f"MAX(b) FILTER (m = {m}) AS b{m}" for m in range(n))} FROM co),
pe AS MATERIALIZED (SELECT id, z{sql.P + 1} AS y, {", ".join(f"z{sql.P + 1} - list_dot_product([{z}], b{m}) AS e{m}" for m in range(n))}
       FROM z, bm WHERE is_test),
{_w("pe", "id", B_RANK)},
per AS (SELECT rep, SUM(w) AS sw, SUM(w * y) AS sy, SUM(w * y * y) AS syy, {sums} FROM w GROUP BY rep
        UNION ALL SELECT -1, COUNT(*), SUM(y), SUM(y * y), {point} FROM pe),
lg_scores AS ({long}),
records AS (SELECT modelo, 'Baseline' AS tipo, {ci} FROM lg_scores GROUP BY modelo),
ranking AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY r2 DESC NULLS LAST, modelo) AS INTEGER) AS rank, modelo, tipo,
                   ROUND(r2, 6) AS r2, ROUND(rmse, 2) AS rmse, ROUND(mae, 2) AS mae, CAST(NULL AS DOUBLE) AS r2_cv_mean,
                   CAST(NULL AS DOUBLE) AS r2_cv_std, CAST(NULL AS DOUBLE) AS rmse_cv_mean,
                   {", ".join(f"ROUND({c}_ci_{e}, {6 if c == 'r2' else 2}) AS {c}_ci_{e}" for c in ("r2", "rmse", "mae") for e in ("lower", "upper"))},
                   printf('%.3f (%.3f-%.3f)', ROUND(r2, 3), ROUND(r2_ci_lower, 3), ROUND(r2_ci_upper, 3)) AS r2_text,
                   'Bootstrap' AS ci_source FROM records)
"""


RANK_SQL = _rank_sql()


def linear_scores(spark, sf, reps: int = B_RANK):
    """Test R2, RMSE and MAE of the five linear models with their bootstrap
    intervals: one pass names the categories, one builds the moment cube that
    all fits and both alpha grids come from, one scores every model and replicate."""
    train, test, design = full_design(spark, sf)
    part = F.when(F.col("is_test"), F.lit(-1)).otherwise(rs.hash_fold("id", K))
    cube = rg.collect_moments(rg.cross_moments(train, design, part), design)
    return rg.score_models(test, design, rg.linear_family(cube, ALPHAS, (ENET_ALPHA, ENET_L1)), "id", reps)


@query("comparison_table", CMP_SQL + "SELECT modelo, tipo, " + ", ".join(
    f"ROUND({c}, {6 if c.startswith('r2') else 2}) AS {c}" for c in rp.RECORD_COLS[2:]) + " FROM cmp")
def comparison_table(spark, sf):
    """CV records joined to test metrics by name, baseline
    records appended with null CV columns, sorted by test R^2 nulls last."""
    return rp.rounded(linear_records(spark, sf))


@query("type_summary", CMP_SQL + """SELECT tipo, CAST(n_models AS BIGINT) AS n_models, modelo AS best_model,
       ROUND(r2_test, 6) AS best_r2_test FROM best WHERE rk = 1""")
def type_summary(spark, sf):
    """Models per type and the best of each."""
    return rp.type_summary(linear_records(spark, sf))


@query("improvement_report", CMP_SQL + f"""SELECT b.modelo AS best_baseline, a.modelo AS best_advanced,
       ROUND(a.r2_test - b.r2_test, 6) AS delta_r2, ROUND((a.r2_test - b.r2_test) / b.r2_test * 100, 4) AS delta_r2_pct,
       ROUND(b.rmse_test - a.rmse_test, 2) AS delta_rmse,
       ROUND((b.rmse_test - a.rmse_test) / b.rmse_test * 100, 4) AS delta_rmse_pct,
       CASE WHEN a.r2_test - b.r2_test > {rp.SIGNIFICANT} THEN 'significant'
            WHEN a.r2_test - b.r2_test > {rp.MARGINAL} THEN 'marginal' ELSE 'none' END AS verdict
FROM (SELECT * FROM best WHERE tipo = 'Baseline' AND rk = 1) b, (SELECT * FROM best WHERE tipo = 'Avanzado' AND rk = 1) a""")
def improvement_report(spark, sf):
    """Best advanced vs best baseline, with the reference's thresholds."""
    return rp.improvement_report(linear_records(spark, sf))


@query("final_ranking", RANK_SQL + "SELECT * FROM ranking")
def final_ranking(spark, sf):
    """The linear models ranked, with intervals of R2, RMSE and MAE."""
    return rp.final_ranking(rp.ranking_records(linear_scores(spark, sf)))


@query("best_model_card", RANK_SQL + "SELECT * FROM ranking WHERE rank = 1")
def best_model_card(spark, sf):
    """The best model's record."""
    return rp.best_model_card(rp.final_ranking(rp.ranking_records(linear_scores(spark, sf))))


# ---- synthetic table (A9) ----------------------------------------------------

# Fixed values of the synthetic law: age ~ N(35, 8), experience ~ Exp(mean 7),
# education 1-4 with p 0.1/0.3/0.4/0.2, gender M/F 0.6/0.4, level
# Bachelor/Master/PhD 0.5/0.3/0.2, seniority 0-3 0.3/0.3/0.25/0.15, area 0-2
# 0.4/0.35/0.25; salary = 50000 + 3000 exp + 15000 edu + 500 age +
# 10000 seniority + 5000 area + N(0, 8000), clipped to [30000, 200000].
SYN_CHOICES = {
    "education_numerica": ([1, 2, 3, 4], [0.1, 0.4, 0.8]),
    "gender": (["M", "F"], [0.6]),
    "education_level": (["Bachelor", "Master", "PhD"], [0.5, 0.8]),
    "llm_seniority": ([0, 1, 2, 3], [0.3, 0.6, 0.85]),
    "llm_functional_area": ([0, 1, 2], [0.4, 0.75]),
}
TWO_PI = 6.283185307179586


def _u(i):
    # md5 once per row (column __h), then one cheap integer mix per draw
    return replicate_uniform(F.col("__h"), F.lit(i))


def _su(i):
    return sql_replicate_uniform("h", str(i))


def _pick(u, values, cuts):
    expr = F.lit(values[-1])
    for v, c in reversed(list(zip(values[:-1], cuts))):
        expr = F.when(u < F.lit(c), F.lit(v)).otherwise(expr)
    return expr


def _sql_pick(u, values, cuts):
    lit = (lambda v: f"'{v}'") if isinstance(values[0], str) else str
    return "(CASE " + " ".join(f"WHEN {u} < {c} THEN {lit(v)}" for v, c in zip(values[:-1], cuts)) + \
        f" ELSE {lit(values[-1])} END)"


@query("synthetic_table", f"""
WITH k AS (SELECT o_orderkey AS id, {sql_hash_u32("o_orderkey", "'syn'")} AS h FROM orders),
b AS (SELECT id,
        35 + 8 * sqrt(-2 * ln(1 - {_su(1)})) * cos({TWO_PI} * {_su(2)}) AS age,
        -7 * ln(1 - {_su(3)}) AS years_experience,
        {_sql_pick(_su(4), *SYN_CHOICES['education_numerica'])} AS education_numerica,
        {_sql_pick(_su(5), *SYN_CHOICES['gender'])} AS gender,
        {_sql_pick(_su(6), *SYN_CHOICES['education_level'])} AS education_level,
        {_sql_pick(_su(7), *SYN_CHOICES['llm_seniority'])} AS llm_seniority,
        {_sql_pick(_su(8), *SYN_CHOICES['llm_functional_area'])} AS llm_functional_area,
        8000 * sqrt(-2 * ln(1 - {_su(9)})) * cos({TWO_PI} * {_su(10)}) AS noise FROM k)
SELECT id, ROUND(age, 6) AS age, ROUND(years_experience, 6) AS years_experience,
       CAST(education_numerica AS INTEGER) AS education_numerica,
       ROUND(years_experience / NULLIF(age, 0), 6) AS ratio_experiencia,
       ROUND(years_experience * years_experience, 6) AS experience2, ROUND(age * years_experience, 6) AS edad_x_experiencia,
       ROUND(ln(1 + years_experience), 6) AS log_experiencia, gender, education_level,
       CAST(llm_seniority AS INTEGER) AS llm_seniority, CAST(llm_functional_area AS INTEGER) AS llm_functional_area,
       ROUND(greatest(30000, least(200000, 50000 + years_experience * 3000 + education_numerica * 15000 + age * 500
             + llm_seniority * 10000 + llm_functional_area * 5000 + noise)), 2) AS salary,
       ROUND(age - years_experience, 6) AS inicio_laboral,
       ROUND(years_experience / NULLIF(age - 18, 0), 6) AS ratio_velocidad_carrera,
       ROUND(years_experience * years_experience * years_experience, 6) AS experience3,
       ROUND(age * years_experience * years_experience, 6) AS edad_x_experiencia2,
       ROUND(education_numerica * years_experience, 6) AS educacion_x_experiencia,
       gender || '_' || education_level AS gender_education FROM b""")
def synthetic_table(spark, sf):
    """The synthetic fallback table with the reference's linear law, one
    row per order key (so it grows with the data); every draw is a keyed hash
    (md5 of the key once, then the integer mixer per draw: Box-Muller
    normals, inverse-CDF exponential, cumulative-weight choices), so it is
    partition-independent and reproducible by the SQL oracle."""
    k = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"),
                                               hash_u32("o_orderkey", "syn").alias("__h"))
    age = F.lit(35.0) + F.lit(8.0) * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _u(1))) * F.cos(F.lit(TWO_PI) * _u(2))
    yrs = F.lit(-7.0) * F.log(F.lit(1.0) - _u(3))
    noise = F.lit(8000.0) * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _u(9))) * F.cos(F.lit(TWO_PI) * _u(10))
    b = k.select("id", age.alias("age"), yrs.alias("years_experience"),
                 *[_pick(_u(i), *SYN_CHOICES[c]).alias(c) for i, c in zip(range(4, 9), SYN_CHOICES)],
                 noise.alias("noise"))
    a, x, e = F.col("age"), F.col("years_experience"), F.col("education_numerica")
    sal = (F.lit(50000.0) + x * 3000 + e * 15000 + a * 500 + F.col("llm_seniority") * 10000 +
           F.col("llm_functional_area") * 5000 + F.col("noise"))
    r = lambda c: F.round(c, 6)
    return b.select("id", r(a).alias("age"), r(x).alias("years_experience"), e.cast("int").alias("education_numerica"),
                    r(F.try_divide(x, a)).alias("ratio_experiencia"), r(x * x).alias("experience2"),
                    r(a * x).alias("edad_x_experiencia"), r(F.log1p(x)).alias("log_experiencia"), "gender",
                    "education_level", F.col("llm_seniority").cast("int").alias("llm_seniority"),
                    F.col("llm_functional_area").cast("int").alias("llm_functional_area"),
                    F.round(clip(sal, 30000.0, 200000.0), 2).alias("salary"), r(a - x).alias("inicio_laboral"),
                    r(F.try_divide(x, a - F.lit(18.0))).alias("ratio_velocidad_carrera"),
                    r(x * x * x).alias("experience3"), r(a * x * x).alias("edad_x_experiencia2"),
                    r(e * x).alias("educacion_x_experiencia"),
                    F.concat(F.col("gender"), F.lit("_"), F.col("education_level")).alias("gender_education"))


# ---- trees ----------------------------------------------------------------

NUMERIC, ONE_HOT, LABELS = ["n_lines", "qty", "no_such_column"], ["segment"], ["priority"]     # B10: only existing columns are used
B_REFIT = 50          # reference: 50 refits for prediction intervals
GBT_FINAL = {**tr.GBT_DEFAULT, "maxIter": tr.FINAL_ROUNDS}
TREES = [("Random Forest", "rf", tr.RF_DEFAULT), ("Gradient Boosting", "gbt", GBT_FINAL)]
_FITTED: dict[tuple, object] = {}


def _matrix(spark, sf):
    """J12 on the split facts; checkpointed (the fits iterate over it)."""
    d, names = tr.model_matrix(split_facts(spark, sf), NUMERIC, ONE_HOT, LABELS, "total", "id", keep=["is_test"])
    d = d.checkpoint()
    return d.where(~F.col("is_test")), d.where(F.col("is_test")), names


def _fitted(spark, sf, kind, params):
    """(model, feature names, test rows): fitted once per application and source folder."""
    at = (spark.sparkContext.applicationId, sf, kind)
    if at not in _FITTED:
        train, test, names = _matrix(spark, sf)
        _FITTED[at] = (tr.fit(kind, params, train, "total"), names, test)
    return _FITTED[at]


def _predict(spark, sf, kind, params):
    m, _, test = _fitted(spark, sf, kind, params)
    return tr.predict(m, test, "id", "total").select("id", "total", F.round("prediction", 2).alias("prediction"))


@query("model_matrix", with_sql(FACTS_SQL) + """
SELECT id, total, CAST(n_lines AS DOUBLE) AS n_lines, qty, """ + ", ".join(
    f"CAST(segment = '{v}' AS DOUBLE) AS var_segment_{v}" for c, v in sql.LEVELS if c == "segment") + """,
       CAST(DENSE_RANK() OVER (ORDER BY priority) - 1 AS DOUBLE) AS priority_encoded FROM facts""")
def model_matrix(spark, sf):
    """The model matrix's entries, one column each; a column that
    does not exist is left out."""
    d, names = tr.model_matrix(facts(spark, sf), NUMERIC, ONE_HOT, LABELS, "total", "id")
    x = vector_to_array("features")
    return d.withColumn("x", x).select("id", "total", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])


@query("stored_model_scores", MULTI_SQL + """,
c AS (SELECT LIST(b ORDER BY i) AS b FROM ols)
SELECT id, ROUND(my + list_dot_product([""" + ", ".join(f"z{i}" for i in range(sql.P + 1)) + """], b), 2) AS prediction
FROM z, c, sc WHERE is_test""")
def stored_model_scores(spark, sf):
    """Scaler, model matrix and a least-squares model fitted on the training
    rows, saved in the shared folder, loaded again and applied to the test rows."""
    train, test, _ = full_design(spark, sf)
    scaler = tf.Scaler(sql.NUMERIC, "robust").fit(train)
    scaled = scaler.transform(train.withColumns({c: F.col(c).cast("double") for c in sql.NUMERIC})).na.drop("any")
    matrix = tr.Matrix.fit(scaled, sql.NUMERIC, sql.ONE_HOT, [])
    model = tr.estimator("ols", {}, "total").fit(matrix.transform(scaled))
    folder = scratch_path(spark, "scorer")
    tr.Scorer(matrix, model, scaler).save(spark, folder)
    return tr.Scorer.load(spark, folder).score(test, "id").select("id", F.round("prediction", 2).alias("prediction"))


@query("rf_predict")
def rf_predict(spark, sf):
    """K8: random forest fitted on the training split, test predictions."""
    return _predict(spark, sf, "rf", tr.RF_DEFAULT)


@query("gbt_predict")
def gbt_predict(spark, sf):
    """K7: gradient-boosted trees (300 rounds), test predictions."""
    return _predict(spark, sf, "gbt", GBT_FINAL)


@query("gbt_rounds")
def gbt_rounds(spark, sf):
    """K7: validation RMSE after each of 200 boosting rounds, and the round that
    early stopping (30 rounds without a better one) chooses."""
    train, _, _ = _matrix(spark, sf)
    d = train.withColumn("fold", rs.hash_fold("id", K))
    errors, chosen = tr.boost_with_stopping(tr.GBT_DEFAULT, d.where("fold <> 0"), d.where("fold = 0"), "total")
    rows = [(i + 1, round(e, 2), i + 1 == chosen) for i, e in enumerate(errors)]
    return spark.createDataFrame(rows, "round int, rmse double, chosen boolean")


@query("feature_importance")
def feature_importance(spark, sf):
    """Top-10 importances of both ensembles, ranked."""
    rows = []
    for name, kind, params in TREES:
        m, names, _ = _fitted(spark, sf, kind, params)
        rows += [(name, i + 1, f, round(v, 6)) for i, (f, v) in enumerate(tr.importances(m, names))]
    return spark.createDataFrame(rows, "modelo string, rank int, feature string, importance double")


@query("random_search")
def random_search(spark, sf):
    """Quick-mode random search (5 trials, 3 folds, 120 s budget
    per model family); one row per trial with its CV RMSE, parameters and the
    rounds early stopping chose."""
    train, _, _ = _matrix(spark, sf)
    with ThreadPoolExecutor(max_workers=len(TREES)) as pool:
        found = list(pool.map(lambda t: tr.random_search(t[1], train, "id", "total", n_trials=5, timeout_s=120.0, k=3), TREES))
    rows = []
    for (name, _, _), (trials, best) in zip(TREES, found):
        for t in trials:
            rows.append((name, t["trial"], round(t["cv_rmse"], 2), json.dumps(t["params"], sort_keys=True), t["rounds"], t["params"] == best))
    return spark.createDataFrame(rows, "modelo string, trial int, cv_rmse double, params string, rounds array<int>, is_best boolean")


@query("bootstrap_prediction_interval")
def bootstrap_prediction_interval(spark, sf):
    """50 Poisson-weighted refits, per-test-row mean and 95 % band."""
    train, test, _ = _matrix(spark, sf)
    out = tr.bootstrap_prediction_interval("rf", tr.RF_DEFAULT, train, test, "id", "total", B_REFIT, parallelism=8)
    return out.select("id", "total", F.round("pred_mean", 2).alias("pred_mean"),
                      F.round("pi_lower", 2).alias("pi_lower"), F.round("pi_upper", 2).alias("pi_upper"), "n_reps")


def tree_pipeline(spark, sf, n_trials: int, timeout_s: float, test_fraction: float, k: int):
    """Matrix -> split -> robust scaling -> search -> final fits -> test metrics
    -> k-fold CV: the comparison rows of both ensembles."""
    f = facts(spark, sf).withColumn("is_test", rs.split_flag("id", test_fraction)).withColumn("n_lines", F.col("n_lines").cast("double"))
    scaler = tf.Scaler(["n_lines", "qty"], "robust").fit(f.where(~F.col("is_test")))
    d, _ = tr.model_matrix(scaler.transform(f), NUMERIC, ONE_HOT, LABELS, "total", "id", keep=["is_test"])
    d = d.checkpoint()
    train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    blocks = tr.Blocks.of(train, "total", rs.hash_fold("id", k, seed=tr.SEED))      # of search, folds and final fits

    def family(name, kind):
        """Both families side by side, and the final fit beside the folds: fits are many small jobs."""
        _, best = tr.random_search(kind, train, "id", "total", n_trials=n_trials, timeout_s=timeout_s, k=k, blocks=blocks)
        final = {**best, "maxIter": tr.FINAL_ROUNDS} if kind == "gbt" else best
        with ThreadPoolExecutor(max_workers=1) as beside:
            cv = beside.submit(tr.fold_predictions, kind, tr.search_params(kind, best), train, "id", "total", k, blocks=blocks)
            p = tr.fit(kind, final, train, "total", blocks).transform(test).select(F.col("total").alias("y"), F.col("prediction").alias("pred"))
            return tr.cv_summary(cv.result(), "total", k, name), _test_metrics(p, name)
    with ThreadPoolExecutor(max_workers=len(TREES)) as pool:
        cvs, tests = zip(*pool.map(lambda t: family(*t[:2]), TREES))
    test_cols = ("tipo", "r2_test", "rmse_test", "mae_test")
    return rp.comparison_table(rp.stack(list(cvs)).select(*[c for c in rp.RECORD_COLS if c not in test_cols]),
                               rp.stack(list(tests)).select("modelo", *test_cols[1:]), None)


@query("pipeline_quick")
def pipeline_quick(spark, sf):
    """L20/L18 in the reference's quick mode (5 trials, 120 s, 30 % test, 3
    folds): both ensembles and the five linear models in one ranking."""
    trees = tree_pipeline(spark, sf, n_trials=5, timeout_s=120.0, test_fraction=0.3, k=3)
    return rp.final_ranking(rp.ranking_records(linear_scores(spark, sf), trees))
