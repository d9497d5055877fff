"""Statistical inference (survey 2L): bootstrap and cross-validated intervals.

Bootstrap replicates never become separate jobs: one exploded, weighted pass
aggregates every replicate at once (partial aggregation per task, so each map
task ships at most B small rows), then percentiles are taken over B rows.
Cross-validation fits every fold from one pass of per-fold moments and scores
the held-out rows in one more pass with a broadcast table of k coefficients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.stats import t_ppf
from lodestar.operators import linear as lin
from lodestar.operators.models import point_metrics, r_squared
from lodestar.operators.resample import percentile_ci, replicate_sums, with_folds


def metrics_with_ci(pred: DataFrame, key: str, y: str, yhat: str, reps: int, name: str) -> DataFrame:
    """L2: point RMSE/MAE/R^2 and their percentile bootstrap intervals."""
    point = point_metrics(pred, y, yhat)
    e = F.col(y) - F.col(yhat)
    per = replicate_sums(pred.select(key, y, yhat), key, reps,
                         {"sw": F.lit(1.0), "se": e * e, "sa": F.abs(e), "sy": F.col(y), "syy": F.col(y) * F.col(y)})
    st = per.select(F.sqrt(F.try_divide(F.col("se"), F.col("sw"))).alias("rmse"), F.try_divide(F.col("sa"), F.col("sw")).alias("mae"),
                    (F.lit(1.0) - F.try_divide(F.col("se"), F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("sw")))).alias("r2"))
    ci = percentile_ci(st, ["rmse", "mae", "r2"])
    j = point.crossJoin(ci)
    cols = [F.lit(name).alias("modelo")]
    for m, d in (("rmse", 2), ("mae", 2), ("r2", 6)):
        cols += [F.round(m, d).alias(m), F.round(f"{m}_ci_lower", d).alias(f"{m}_ci_lower"),
                 F.round(f"{m}_ci_upper", d).alias(f"{m}_ci_upper")]
    return j.select(*cols)


def simple_coef_ci(src: DataFrame, key: str, reps: int) -> DataFrame:
    """Bootstrap intervals of intercept and slope of y ~ x."""
    full = src.agg(F.regr_intercept("y", "x").alias("b0"), F.regr_slope("y", "x").alias("b1"))
    x, yy = F.col("x"), F.col("y")
    per = replicate_sums(src, key, reps, {"sw": F.lit(1.0), "sx": x, "sy": yy, "sxx": x * x, "sxy": x * yy})
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    intercept = F.try_divide(F.col("sy"), F.col("sw")) - slope * F.try_divide(F.col("sx"), F.col("sw"))
    # a replicate that cannot be fitted keeps the original coefficients
    cf = per.crossJoin(F.broadcast(full)).select(F.coalesce(slope, "b1").alias("slope"), F.coalesce(intercept, "b0").alias("intercept"))
    ci = percentile_ci(cf, ["intercept", "slope"])
    j = full.crossJoin(ci)
    rows = [F.struct(F.lit(t).alias("term"), F.col(v).alias("value"), F.col(f"{c}_ci_lower").alias("lo"),
                     F.col(f"{c}_ci_upper").alias("hi")) for t, v, c in
            (("intercept", "b0", "intercept"), ("slope", "b1", "slope"))]
    return j.select(F.explode(F.array(*rows)).alias("r")).select(
        "r.term", F.round("r.value", 4).alias("value"), F.round("r.lo", 4).alias("ci_lower"),
        F.round("r.hi", 4).alias("ci_upper"))


def _two_predictor_coefs(sums: DataFrame) -> DataFrame:
    """Closed-form 2-predictor OLS from weighted raw sums (per row of ``sums``)."""
    c = F.col
    sw = c("sw")
    over = F.try_divide                         # null where there are no rows or the predictors are collinear
    c11 = c("s11") - over(c("sx1") * c("sx1"), sw)
    c12 = c("s12") - over(c("sx1") * c("sx2"), sw)
    c22 = c("s22") - over(c("sx2") * c("sx2"), sw)
    c1y = c("s1y") - over(c("sx1") * c("sy"), sw)
    c2y = c("s2y") - over(c("sx2") * c("sy"), sw)
    det = c11 * c22 - c12 * c12
    b1 = over(c22 * c1y - c12 * c2y, det)
    b2 = over(c11 * c2y - c12 * c1y, det)
    b0 = over(c("sy"), sw) - b1 * over(c("sx1"), sw) - b2 * over(c("sx2"), sw)
    keep = [x for x in sums.columns if x in ("rep", "fold")]
    return sums.select(*keep, b0.alias("b0"), b1.alias("b1"), b2.alias("b2"))


def _weighted_sums(df: DataFrame, w: Column) -> list[Column]:
    x1, x2, y = F.col("x1"), F.col("x2"), F.col("y")
    return [F.sum(w).alias("sw"), F.sum(w * x1).alias("sx1"), F.sum(w * x2).alias("sx2"), F.sum(w * y).alias("sy"),
            F.sum(w * x1 * x1).alias("s11"), F.sum(w * x1 * x2).alias("s12"), F.sum(w * x2 * x2).alias("s22"),
            F.sum(w * x1 * y).alias("s1y"), F.sum(w * x2 * y).alias("s2y")]


def round_metric(metric: Column, value: Column) -> Column:
    """R^2 to 6 decimals, error metrics (money) to 2."""
    return F.when(metric == "R2", F.round(value, 6)).otherwise(F.round(value, 2))


def cv_interval(train: DataFrame, key: str, k: int, contiguous: bool, sample_sd: bool,
                x: str = "n_lines", y: str = "total") -> DataFrame:
    """L3/L4: k-fold CV of y ~ x; per-fold R^2, RMSE, MAE -> mean, sd and a
    t-interval with k-1 degrees of freedom."""
    spark = train.sparkSession
    d = train.select(key, F.col(x).cast("double").alias("x"), F.col(y).alias("y"))
    d = with_folds(d, key, k, contiguous=contiguous)
    folds = lin.moments(d, ["x"], "y", by="fold")                # k rows collected
    coefs = []
    for f in sorted(folds):
        b0, beta = lin.solve(lin.fold_out(folds, f))
        coefs.append((int(f), float(b0), float(beta[0])))
    co = spark.createDataFrame(coefs, "fold int, b0 double, b1 double")
    e = F.col("y") - F.col("b0") - F.col("b1") * F.col("x")
    pm = d.join(F.broadcast(co), "fold").groupBy("fold").agg(
        r_squared("y", e).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    lg = pm.select(F.explode(F.array(
        F.struct(F.lit("R2").alias("metric"), F.col("r2").alias("v")),
        F.struct(F.lit("Root Mean Squared Error").alias("metric"), F.col("rmse").alias("v")),
        F.struct(F.lit("Mean Absolute Error").alias("metric"), F.col("mae").alias("v")))).alias("s")).select("s.*")
    sd = F.stddev_samp("v") if sample_sd else F.stddev_pop("v")
    ag = lg.groupBy("metric").agg(F.avg("v").alias("mean"), sd.alias("sd"), F.count(F.lit(1)).alias("k"))
    t = t_ppf(0.975, k - 1)
    half = F.lit(t) * F.col("sd") / F.sqrt("k")
    m = F.col("metric")
    return ag.select("metric", round_metric(m, F.col("mean")).alias("mean"), round_metric(m, F.col("sd")).alias("std"),
                     round_metric(m, F.col("mean") - half).alias("ci_lower"),
                     round_metric(m, F.col("mean") + half).alias("ci_upper"))


def jarque_bera(train: DataFrame, y: str, x: str) -> DataFrame:
    """Jarque-Bera test of the residuals of y ~ x (population moments),
    p = exp(-JB/2) (chi-square with 2 df); normal when p > 0.05."""
    fit = train.agg(F.regr_slope(y, x).alias("__b1"), F.regr_intercept(y, x).alias("__b0"))
    r = train.crossJoin(F.broadcast(fit)).select(
        (F.col(y) - (F.col("__b0") + F.col("__b1") * F.col(x).cast("double"))).alias("e"))
    m = r.agg(F.count(F.lit(1)).alias("n"), F.skewness("e").alias("s"), F.kurtosis("e").alias("k"))
    jb = F.col("n") / 6.0 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4.0)
    p = F.exp(-jb / 2.0)
    return m.select(F.col("n").cast("bigint").alias("n"), F.round("s", 6).alias("skewness"),
                    F.round("k", 6).alias("excess_kurtosis"), F.round(jb, 4).alias("jb"),
                    F.round(p, 10).alias("p_value"), (p > 0.05).alias("normal"))
