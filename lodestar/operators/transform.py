"""Feature transformers (survey 2J).

A fitted scaler is a one-row DataFrame of parameters (never collected); it is
applied with a broadcast cross join, so fitting on the training split and
transforming any other frame is one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.stats import inv_normal
from lodestar.operators import profile as pf
from lodestar.operators.categories import encode, fit_categories

METHODS = ("standard", "robust", "minmax")


class NotFittedError(RuntimeError):
    pass


class Scaler:
    """Standard (population sd), robust (median/IQR) or min-max."""

    def __init__(self, cols: list[str], method: str = "robust"):
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        self.cols, self.method = cols, method
        self.params: DataFrame | None = None

    def fit(self, df: DataFrame) -> "Scaler":
        if self.method == "standard":
            aggs = [e for c in self.cols for e in (F.avg(c).alias(f"{c}__c"), F.stddev_pop(c).alias(f"{c}__s"))]
            self.params = df.agg(*aggs)
        elif self.method == "minmax":
            aggs = [e for c in self.cols for e in (F.min(F.col(c).cast("double")).alias(f"{c}__c"),
                                                   (F.max(c) - F.min(c)).cast("double").alias(f"{c}__s"))]
            self.params = df.agg(*aggs)
        else:
            vals = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v"))
                                                 for c in self.cols])).alias("s")).select("s.name", "s.v")
            q = pf.quantiles_wide(vals, "v", [0.25, 0.5, 0.75], ["q1", "med", "q3"], by=["name"])
            self.params = q.agg(*[e for c in self.cols for e in (
                F.max(F.when(F.col("name") == c, F.col("med"))).alias(f"{c}__c"),
                F.max(F.when(F.col("name") == c, F.col("q3") - F.col("q1"))).alias(f"{c}__s"))])
        return self

    def _check(self):
        if self.params is None:
            raise NotFittedError("scaler is not fitted; call fit() first")

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        self._check()
        j = df.crossJoin(F.broadcast(self.params))
        scaled = {c: F.try_divide(F.col(c) - F.col(f"{c}__c"), F.col(f"{c}__s")) for c in self.cols}
        out = [scaled[c].alias(c + suffix) if (c in scaled and not suffix) else F.col(c) for c in df.columns]
        if suffix:
            out += [scaled[c].alias(c + suffix) for c in self.cols]
        return j.select(*out)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Scaled columns (same names) back to the original units."""
        self._check()
        j = df.crossJoin(F.broadcast(self.params))
        return j.select(*[(F.col(c) * F.col(f"{c}__s") + F.col(f"{c}__c")).alias(c) if c in self.cols
                          else F.col(c) for c in df.columns])

    def scales(self) -> DataFrame:
        """(feature, scale), one row per scaled column."""
        self._check()
        return self.params.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__s").alias("scale"))
                                                      for c in self.cols])).alias("s")).select("s.*")


def rescaled_importances(importances: DataFrame, scaler: Scaler, digits: int = 6) -> DataFrame:
    """(feature, importance) divided by the scale of the feature; a feature
    without a scale keeps its importance, a scale of zero gives null."""
    j = importances.join(F.broadcast(scaler.scales()), "feature", "left")          # one row per scaled column
    rescaled = F.when(F.col("scale").isNotNull(), F.abs(F.try_divide("importance", "scale"))).otherwise(F.col("importance"))
    return j.select("feature", F.round("importance", digits).alias("importance"), F.round("scale", digits).alias("scale"),
                    F.round(rescaled, digits).alias("importance_rescaled"))


def range_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """min/max per column (long form)."""
    wide = df.agg(*[e for c in cols for e in (F.min(F.col(c).cast("double")).alias(f"{c}__min"),
                                              F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                    F.col(f"{c}__min").alias("min"),
                                                    F.col(f"{c}__max").alias("max")) for c in cols])).alias("s")) \
        .select("s.*")


MAX_DUMMIES = 1000       # wide dummy columns; more categories go through ``trees.Matrix`` as a sparse vector


def one_hot_drop_first(df: DataFrame, col: str, prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """Dummy columns for every category but the alphabetically first.  The
    categories name columns, so there may be MAX_DUMMIES of them at most."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_DUMMIES + 1).collect()
    if len(found) > MAX_DUMMIES:
        raise ValueError(f"{col} has more than {MAX_DUMMIES} categories: use a fitted matrix (trees.Matrix)")
    cats = sorted(r[0] for r in found)
    prefix = prefix or col
    names = [f"{prefix}_{c}".replace(" ", "_").replace("-", "_") for c in cats[1:]]
    out = df.select("*", *[(F.col(col) == F.lit(c)).cast("double").alias(n) for c, n in zip(cats[1:], names)])
    return out, names


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Rows without a value are dropped, the others cast to text and
    numbered by the sorted distinct values (0..k-1)."""
    kept = df.where(F.col(col).isNotNull())
    return encode(kept, col, fit_categories(kept, [col]), out or f"{col}_idx")


def quantile_normal(train: DataFrame, df: DataFrame, col: str, n_quantiles: int = 100, out: str | None = None,
                    bound: float = 1e-7) -> DataFrame:
    """Map a column to a standard normal through its empirical CDF.

    The CDF is piecewise linear through ``n_quantiles`` training quantiles at
    evenly spaced probabilities (a bounded array, broadcast as one row); the
    probability is clipped to [bound, 1-bound] and sent through Phi^-1.
    """
    out = out or f"{col}_qn"
    probs = [i / (n_quantiles - 1) for i in range(n_quantiles)]
    q = pf.quantiles(train, col, probs)
    grid = q.agg(F.array_sort(F.collect_list(F.struct("p_index", "q"))).alias("__g")) \
        .select(F.transform("__g", lambda s: s["q"]).alias("__g"))
    j = df.crossJoin(F.broadcast(grid))
    x = F.col(col).cast("double")
    cnt = F.size(F.filter("__g", lambda g: g <= x))          # grid points <= x
    lo_i = F.greatest(F.lit(1), F.least(cnt, F.lit(n_quantiles - 1)))  # 1-based left end
    g_lo = F.element_at("__g", lo_i)
    g_hi = F.element_at("__g", lo_i + 1)
    frac = F.when(g_hi > g_lo, (x - g_lo) / (g_hi - g_lo)).otherwise(F.lit(0.0))
    p = (lo_i - 1 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), frac))) / F.lit(float(n_quantiles - 1))
    p = F.greatest(F.lit(bound), F.least(F.lit(1 - bound), p))
    return j.withColumn(out, inv_normal(p)).drop("__g")
