"""Point metrics and analytic intervals as expressions over prediction frames (2L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.stats import t975_expr


def r_squared(y: str, error: Column) -> Column:
    """Aggregate R^2 of the errors; null for a constant target."""
    return F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(F.lit(1)))


def point_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """L1: n, RMSE, MAE, R^2 in one aggregation."""
    e = F.col(y) - F.col(pred)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                  r_squared(y, e).alias("r2"))


def interval_frame(df: DataFrame, x: Column) -> DataFrame:
    """Mean CI and prediction interval at ``x`` for a simple fit.

    ``df`` carries the fit columns slope, intercept, n, mx, sxx, sse;
    mse = sse / n (reference semantics); t has n - 2 degrees of freedom.
    """
    mse = F.col("sse") / F.col("n")
    lev = F.lit(1.0) / F.col("n") + F.pow(x - F.col("mx"), 2) / F.col("sxx")
    se_m = F.sqrt(mse * lev)
    se_p = F.sqrt(mse * (F.lit(1.0) + lev))
    t = t975_expr(F.col("n") - 2)
    yh = F.col("intercept") + F.col("slope") * x
    return df.select("*", yh.alias("y_hat"), (yh - t * se_m).alias("ci_lower"), (yh + t * se_m).alias("ci_upper"),
                     (yh - t * se_p).alias("pi_lower"), (yh + t * se_p).alias("pi_upper"))
