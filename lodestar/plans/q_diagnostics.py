"""Step 11: the remaining table operators of the inventory -- approximate
multiple-regression intervals (L8), scaler range report and comparison
(J10/J11), importance rescaling (J9), shape / scatter / error-bar series
(D24-D26), metric-name cleaning (H19), default fill by column class (B13) and
description prompts with a null default (H15/M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.features import metric_name_clean
from lodestar.functions.hashing import sql_hash_u32
from lodestar.functions.stats import sql_t975, t975_expr
from lodestar.operators import inference as inf
from lodestar.operators import reports as rp
from lodestar.operators import resample as rs
from lodestar.operators import regression as rg
from lodestar.operators import transform as tf
from lodestar.plans.facts import FACTS_SQL, facts, with_sql
from lodestar.plans.q_models import CMP_SQL, RANK_SQL, _xy, linear_scores
from lodestar.plans.q_linear import MULTI_SQL, full_design
from lodestar.plans.q_split import NUM, SPLIT_SQL, split_facts
from lodestar.plans.registry import query


# ---- L8: approximate intervals of the multiple regression ---------------------

@query("multi_approx_interval", CMP_SQL.rstrip() + f""",
ms AS (SELECT AVG(pow(tr.y - (mc.b0 + mc.b1 * tr.x1 + mc.b2 * tr.x2), 2)) AS mse, COUNT(*) AS n FROM tr, mc),
pi AS (SELECT te.id, te.y, mc.b0 + mc.b1 * te.x1 + mc.b2 * te.x2 AS pred, sqrt(mse / n) AS se,
              sqrt(mse + mse / n) AS sp, {sql_t975('n - 3')} AS t FROM te, mc, ms)
SELECT id, y AS total, ROUND(pred, 2) AS pred, ROUND(pred - t * se, 2) AS ci_lower, ROUND(pred + t * se, 2) AS ci_upper,
       ROUND(pred - t * sp, 2) AS pi_lower, ROUND(pred + t * sp, 2) AS pi_upper FROM pi""")
def multi_approx_interval(spark, sf):
    """For k > 1 predictors the reference approximates the mean CI by
    se = sqrt(mse/n) and the PI by sqrt(mse + se^2); mse = mean squared
    training residual, t with n - k - 1 degrees of freedom."""
    d = _xy(spark, sf)
    train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    co = inf._two_predictor_coefs(train.agg(*inf._weighted_sums(train, F.lit(1.0))))
    yhat = F.col("b0") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2")
    ms = train.crossJoin(F.broadcast(co)).agg(F.avg(F.pow(F.col("y") - yhat, 2)).alias("mse"),
                                              F.count(F.lit(1)).alias("n"))
    j = test.crossJoin(F.broadcast(co)).crossJoin(F.broadcast(ms))
    se = F.sqrt(F.col("mse") / F.col("n"))
    sp = F.sqrt(F.col("mse") + F.col("mse") / F.col("n"))
    t = t975_expr(F.col("n") - 3)
    p = yhat
    return j.select("id", F.col("y").alias("total"), F.round(p, 2).alias("pred"),
                    F.round(p - t * se, 2).alias("ci_lower"), F.round(p + t * se, 2).alias("ci_upper"),
                    F.round(p - t * sp, 2).alias("pi_lower"), F.round(p + t * sp, 2).alias("pi_upper"))


# ---- J10 / J11: scaler range report and comparison -------------------------

_CENTER_SCALE = {
    "robust": ("QUANTILE_CONT({c}, 0.5)", "QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25)"),
    "standard": ("AVG({c})", "STDDEV_POP({c})"),
    "minmax": ("MIN(CAST({c} AS DOUBLE))", "MAX({c}) - MIN({c})"),
}


def _scaled_sql_cte(name: str, method: str) -> str:
    center, scale = _CENTER_SCALE[method]
    params = ", ".join(f"{center.format(c=c)} AS c_{c}, {scale.format(c=c)} AS s_{c}" for c in NUM)
    cols = ", ".join(f"(CAST({c} AS DOUBLE) - c_{c}) / NULLIF(s_{c}, 0) AS {c}" for c in NUM)
    return (f"p_{name} AS (SELECT {params} FROM split WHERE NOT is_test),\n"
            f"{name} AS (SELECT id, {cols} FROM split, p_{name})")


def _long_minmax_sql(src: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{c}' AS column_name, ROUND(MIN(CAST({c} AS DOUBLE)), 6) AS min, "
        f"ROUND(MAX(CAST({c} AS DOUBLE)), 6) AS max FROM {src}" for c in NUM)


@query("scale_range_report", with_sql(FACTS_SQL, SPLIT_SQL) + ",\n" + _scaled_sql_cte("rb", "robust") + """
SELECT 'before' AS stage, * FROM (""" + _long_minmax_sql("split") + """)
UNION ALL SELECT 'after', * FROM (""" + _long_minmax_sql("rb") + ")")
def scale_range_report(spark, sf):
    """min/max of every column before and after robust scaling."""
    f = split_facts(spark, sf)
    sc = tf.Scaler(NUM, "robust").fit(f.where(~F.col("is_test")))
    before = tf.range_report(f, NUM).withColumn("stage", F.lit("before"))
    after = tf.range_report(sc.transform(f.select("id", *NUM)), NUM).withColumn("stage", F.lit("after"))
    return before.unionByName(after).select("stage", "column_name", F.round("min", 6).alias("min"),
                                            F.round("max", 6).alias("max"))


@query("scaler_comparison", with_sql(FACTS_SQL, SPLIT_SQL) + ",\n" + ",\n".join(
    _scaled_sql_cte(m[:2], m) for m in ("robust", "standard", "minmax")) + "\n" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, '{c}' AS column_name, ROUND(MIN({c}), 6) AS min, ROUND(MAX({c}), 6) AS max, "
    f"ROUND(AVG({c}), 6) AS mean FROM {m[:2]}" for m in ("robust", "standard", "minmax") for c in NUM))
def scaler_comparison(spark, sf):
    """Robust, standard and min-max scaling side by side (range and
    mean of every scaled column, one aggregation per method)."""
    f = split_facts(spark, sf)
    train = f.where(~F.col("is_test"))
    parts = []
    for m in ("robust", "standard", "minmax"):
        z = tf.Scaler(NUM, m).fit(train).transform(f.select("id", *NUM))
        wide = z.agg(*[e for c in NUM for e in (F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
                                                F.avg(c).alias(f"{c}__mean"))])
        parts.append(wide.select(F.explode(F.array(*[F.struct(
            F.lit(m).alias("method"), F.lit(c).alias("column_name"), F.round(f"{c}__min", 6).alias("min"),
            F.round(f"{c}__max", 6).alias("max"), F.round(f"{c}__mean", 6).alias("mean")) for c in NUM]))
            .alias("s")).select("s.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("importance_rescaled", MULTI_SQL + """,
sc2 AS (SELECT 'n_lines' AS feature, QUANTILE_CONT(n_lines, 0.75) - QUANTILE_CONT(n_lines, 0.25) AS scale FROM split WHERE NOT is_test
        UNION ALL SELECT 'qty', QUANTILE_CONT(qty, 0.75) - QUANTILE_CONT(qty, 0.25) FROM split WHERE NOT is_test)
SELECT term AS feature, ROUND(abs(b), 6) AS importance, ROUND(scale, 6) AS scale,
       ROUND(CASE WHEN scale IS NOT NULL THEN abs(abs(b) / NULLIF(scale, 0)) ELSE abs(b) END, 6) AS importance_rescaled
FROM ols JOIN sd ON sd.i = ols.i LEFT JOIN sc2 ON sc2.feature = sd.term""")
def importance_rescaled(spark, sf):
    """Importances (absolute standardised coefficients) divided by the robust
    scale of their feature; features without a scale keep their importance."""
    train, _, design = full_design(spark, sf)
    imp = rg.solve_each(rg.cross_moments(train, design, F.lit(0)), design, min_norm=True).where("term <> 'intercept'").select(
        F.col("term").alias("feature"), F.abs("std_coef").alias("importance"))
    return tf.rescaled_importances(imp, tf.Scaler(["n_lines", "qty"], "robust").fit(train))


# ---- D24-D26: shape, scatter and error-bar series ----------------------------

@query("shape", with_sql(FACTS_SQL) + "SELECT COUNT(*) AS n_rows, 6 AS n_columns FROM facts")
def shape(spark, sf):
    """Rows x columns of the working table."""
    f = facts(spark, sf)
    return f.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(f.columns)).alias("n_columns"))


@query("scatter_series", CMP_SQL.rstrip() + """
SELECT te.id, te.y AS actual, ROUND(f1.b0 + f1.b1 * te.x1, 2) AS predicted, sp.segment
FROM te, f1, split sp WHERE sp.id = te.id""")
def scatter_series(spark, sf):
    """Actual vs predicted (simple OLS on the test split) with a hue
    column, every row of it."""
    d = split_facts(spark, sf)
    x = _xy(spark, sf)
    train, test = x.where(~F.col("is_test")), x.where(F.col("is_test"))
    fit = train.agg(F.regr_slope("y", "x1").alias("b1"), F.regr_intercept("y", "x1").alias("b0"))
    j = test.crossJoin(F.broadcast(fit))
    j = j.join(d.select("id", "segment"), "id")
    return j.select("id", F.col("y").alias("actual"), F.round(F.col("b0") + F.col("b1") * F.col("x1"), 2)
                    .alias("predicted"), "segment")


@query("error_bar_series", RANK_SQL + " UNION ALL ".join(
    f"""SELECT modelo, '{m.upper()}' AS metric, ROUND({m}, {d}) AS value, ROUND({m} - {m}_ci_lower, {d}) AS err_minus,
       ROUND({m}_ci_upper - {m}, {d}) AS err_plus FROM records""" for m, d in (("r2", 6), ("rmse", 2), ("mae", 2))))
def error_bar_series(spark, sf):
    """(value, value - lower, upper - value) per linear model and metric."""
    return rp.error_bars(rp.ranking_records(linear_scores(spark, sf)))


# ---- H19: metric names of fold scores ---------------------------------------

_FOLD_SQL = with_sql(FACTS_SQL, SPLIT_SQL) + f""",
d AS (SELECT id, CAST({sql_hash_u32('id', "'fold42'")} % 5 AS INTEGER) AS fold, CAST(n_lines AS DOUBLE) AS x,
             total AS y FROM split WHERE NOT is_test),
fs AS (SELECT fold, COUNT(*) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(x * y) AS sxy FROM d GROUP BY fold),
tt AS (SELECT SUM(n) AS n, SUM(sx) AS sx, SUM(sy) AS sy, SUM(sxx) AS sxx, SUM(sxy) AS sxy FROM fs),
t2 AS (SELECT fs.fold, tt.n - fs.n AS n, tt.sx - fs.sx AS sx, tt.sy - fs.sy AS sy, tt.sxx - fs.sxx AS sxx,
              tt.sxy - fs.sxy AS sxy FROM fs, tt),
co AS (SELECT fold, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1,
              sy / n - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx / n AS b0 FROM t2),
pm AS (SELECT d.fold, 1 - SUM(pow(y - b0 - b1 * x, 2)) / (VAR_POP(y) * COUNT(*)) AS r2,
              sqrt(AVG(pow(y - b0 - b1 * x, 2))) AS rmse, AVG(abs(y - b0 - b1 * x)) AS mae
       FROM d JOIN co ON co.fold = d.fold GROUP BY d.fold),
raw AS (SELECT fold, 'r2' AS scorer, r2 AS score FROM pm
        UNION ALL SELECT fold, 'neg_root_mean_squared_error', -rmse FROM pm
        UNION ALL SELECT fold, 'neg_mean_absolute_error', -mae FROM pm)"""


@query("metric_names_clean", _FOLD_SQL + """
SELECT fold, scorer,
       array_to_string(list_transform(string_split(replace(regexp_replace(scorer, '^neg_', ''), '_', ' '), ' '),
                                      lambda w: upper(w[1]) || lower(w[2:])), ' ') AS metric,
       ROUND(CASE WHEN starts_with(scorer, 'neg_') THEN -score ELSE score END, 6) AS value FROM raw""")
def metric_names_clean(spark, sf):
    """Scorer names as the CV reports print them (strip neg_, spaces,
    title case) and negated error scores back to positive errors."""
    d = split_facts(spark, sf).where(~F.col("is_test")).select(
        "id", rs.hash_fold("id", 5).alias("fold"), F.col("n_lines").cast("double").alias("x"), F.col("total").alias("y"))
    fs = d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
                               F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    sums = ["n", "sx", "sy", "sxx", "sxy"]
    tot = fs.agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    t2 = fs.crossJoin(tot).select("fold", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in sums])
    c = F.col
    b1 = (c("n") * c("sxy") - c("sx") * c("sy")) / (c("n") * c("sxx") - c("sx") * c("sx"))
    co = t2.select("fold", b1.alias("b1"), (c("sy") / c("n") - b1 * c("sx") / c("n")).alias("b0"))
    e = c("y") - c("b0") - c("b1") * c("x")
    pm = d.join(F.broadcast(co), "fold").groupBy("fold").agg(
        (F.lit(1.0) - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    raw = pm.select("fold", F.explode(F.array(
        F.struct(F.lit("r2").alias("scorer"), c("r2").alias("score")),
        F.struct(F.lit("neg_root_mean_squared_error").alias("scorer"), (-c("rmse")).alias("score")),
        F.struct(F.lit("neg_mean_absolute_error").alias("scorer"), (-c("mae")).alias("score")))).alias("s"))
    raw = raw.select("fold", "s.scorer", "s.score")
    return raw.select("fold", "scorer", metric_name_clean(c("scorer")).alias("metric"),
                      F.round(F.when(c("scorer").startswith("neg_"), -c("score")).otherwise(c("score")), 6)
                      .alias("value"))
