"""Relationships, distributions and residual diagnostics (2D D13-D26).

Scalars (fitted line, moments, bounds) are one-row aggregates joined back
with a broadcast cross join: nothing is collected, and the broadcast side is
one row by construction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import profile as pf


def simple_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """K1: OLS line y ~ x as a one-row frame (slope, intercept, r2, n)."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def with_residuals(df: DataFrame, y: str, x: str, fit: DataFrame | None = None) -> DataFrame:
    """Prediction and residual columns from a fitted line."""
    fit = fit if fit is not None else simple_fit(df, y, x)
    j = df.crossJoin(F.broadcast(fit.select("slope", "intercept")))
    pred = F.col("intercept") + F.col("slope") * F.col(x).cast("double")
    return j.withColumn("pred", pred).withColumn("residual", F.col(y) - F.col("pred")).drop("slope", "intercept")


def corr_long(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """Pairwise-complete Pearson correlation matrix in long form (a, b, r).

    One aggregation computes every upper-triangle pair; the diagonal is 1 and
    the lower triangle mirrors the upper one.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    rows = []
    for a, b in pairs:
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")))
        rows.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"{a}__{b}").alias("r")))
    for c in cols:
        rows.append(F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")))
    return wide.select(F.explode(F.array(*rows)).alias("p")).select(
        "p.a", "p.b", F.round("p.r", digits).alias("r"))


def strength_label(r: Column) -> Column:
    """Correlation strength label (fixed reference wording)."""
    a = F.abs(r)
    return F.when(a > 0.9, "Muy Alta").when(a > 0.7, "Alta").otherwise("Moderada")


def advice(r: Column, with_target: Column) -> Column:
    """What a correlation means for a model: two predictors above 0.95 call
    for new variables or regularisation, a predictor and the target above 0.9
    for a linear model."""
    return F.when(~with_target & (r > 0.95), "regularise").when(with_target & (r > 0.9), "linear").otherwise("none")


def box_stats(df: DataFrame, value: str, by: list[str], digits: int = 4) -> DataFrame:
    """Grouped five-number summary with 1.5 IQR whisker limits."""
    q = pf.quantiles_wide(df, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=by)
    mm = df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    j = q.join(mm, by)
    iqr = F.col("q3") - F.col("q1")
    return j.select(*by, "n", *[F.round(c, digits).alias(c) for c in ["min", "q1", "median", "q3", "max"]],
                    F.round(iqr, digits).alias("iqr"),
                    F.round(F.col("q1") - 1.5 * iqr, digits).alias("lower_fence"),
                    F.round(F.col("q3") + 1.5 * iqr, digits).alias("upper_fence"))


def histogram(df: DataFrame, value: str, bins: int = 15, digits: int = 10) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed; a constant column is all in
    bin 0, without a density), with density
    count / (n * width); empty bins are kept."""
    spark = df.sparkSession
    m = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    binned = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(m)).select(
        F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(m))
    out = grid.join(counts, "bin", "left").fillna(0, subset=["count"])
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return out.select("bin", F.round(F.col("lo") + w * F.col("bin"), 4).alias("bin_lo"),
                      F.round(F.col("lo") + w * (F.col("bin") + 1), 4).alias("bin_hi"), "count",
                      F.round(F.try_divide(F.col("count"), F.col("n") * w), digits).alias("density"))


def normal_curve(df: DataFrame, value: str, points: int = 100, digits: int = 12) -> DataFrame:
    """Normal pdf with the column's mean and population sd on a grid."""
    spark = df.sparkSession
    m = df.agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"),
               F.min(value).alias("lo"), F.max(value).alias("hi"))
    grid = spark.range(points).withColumnRenamed("id", "i").crossJoin(F.broadcast(m))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i").cast("double") / F.lit(float(points - 1))
    pdf = F.try_divide(F.exp(F.lit(-0.5) * F.pow(F.try_divide(x - F.col("mu"), F.col("sd")), 2)), F.col("sd") * F.lit(math.sqrt(2 * math.pi)))
    return grid.select("i", F.round(x, 4).alias("x"), F.round(pdf, digits).alias("pdf"))


def residual_summary(res: DataFrame, col: str = "residual", digits: int = 4) -> DataFrame:
    """Mean, population sd, min, max of residuals."""
    return res.agg(*[(F.round(e, digits) + F.lit(0.0)).alias(n) for n, e in [
        ("mean", F.avg(col)), ("sd", F.stddev_pop(col)), ("min", F.min(col)), ("max", F.max(col))]])


def sigma_band(res: DataFrame, col: str = "residual", k: float = 2.0) -> DataFrame:
    """Membership in the +-k sigma residual band."""
    s = res.agg(F.stddev_pop(col).alias("__sd"))
    j = res.crossJoin(F.broadcast(s))
    inside = F.abs(F.col(col)) <= F.lit(k) * F.col("__sd")
    return j.agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"),
                 F.round(F.count_if(inside) * 100.0 / F.count(F.lit(1)), 4).alias("pct_inside"),
                 F.round(F.lit(k) * F.first("__sd"), 4).alias("band_half_width"))


def heteroscedasticity(res: DataFrame, threshold: float = 0.3) -> DataFrame:
    """|corr(|residual|, prediction)| > threshold."""
    return res.agg(F.corr(F.abs("residual"), F.col("pred")).alias("__r")).select(
        F.round("__r", 6).alias("r_abs_res_pred"), (F.abs("__r") > threshold).alias("heteroscedastic"))
