"""Model comparison and reporting tables (2L L13, L15-L19; 2E E1-E2; 2F F3-F5).

A model record is one row per model: ``modelo``, ``tipo`` and any of the
test metrics (``r2_test``, ``rmse_test``, ``mae_test``) and CV summaries
(``{r2,rmse,mae}_cv_{mean,std,ci_lower,ci_upper}``).  Records from different
producers are stacked with ``unionByName(allowMissingColumns=True)``.  The
record tables hold a handful of rows, so windows without a partition and
cross joins of one-row frames are used freely here -- never on data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.features import interval_text

RECORD_COLS = ["modelo", "tipo", "r2_cv_mean", "r2_cv_std", "r2_cv_ci_lower", "r2_cv_ci_upper", "rmse_cv_mean",
               "rmse_cv_ci_lower", "rmse_cv_ci_upper", "r2_test", "rmse_test", "mae_test"]
BASELINE, ADVANCED = "Baseline", "Avanzado"
SIGNIFICANT, MARGINAL = 0.01, 0.002


def stack(records: list[DataFrame]) -> DataFrame:
    """Append records with different column sets (missing -> null)."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), records)
    for c in RECORD_COLS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out


def comparison_table(cv: DataFrame, test: DataFrame, baselines: DataFrame | None) -> DataFrame:
    """CV rows enriched with test metrics by model name, baseline rows
    (test metrics only) appended, sorted by test R^2, nulls last."""
    adv = cv.join(test, "modelo", "left").withColumn("tipo", F.lit(ADVANCED))
    parts = [adv] + ([baselines.withColumn("tipo", F.lit(BASELINE))] if baselines is not None else [])
    return stack(parts).select(*RECORD_COLS).orderBy(F.col("r2_test").desc_nulls_last(), "modelo")


def rounded(cmp: DataFrame) -> DataFrame:
    """R^2 to 6 decimals, money to 2."""
    return cmp.select("modelo", "tipo", *[F.round(c, 6 if c.startswith("r2") else 2).alias(c)
                                          for c in RECORD_COLS[2:]])


def type_summary(cmp: DataFrame) -> DataFrame:
    """Number of models and the best model of each type."""
    w = Window.partitionBy("tipo").orderBy(F.col("r2_test").desc_nulls_last(), F.col("modelo"))
    ranked = cmp.withColumn("__r", F.row_number().over(w)).withColumn(
        "n_models", F.count(F.lit(1)).over(Window.partitionBy("tipo")))
    return ranked.where(F.col("__r") == 1).select("tipo", F.col("n_models").cast("bigint").alias("n_models"),
                                                 F.col("modelo").alias("best_model"),
                                                 F.round("r2_test", 6).alias("best_r2_test"))


def improvement_report(cmp: DataFrame) -> DataFrame:
    """Best advanced vs best baseline; deltas and verdict
    (> 0.01 significant, > 0.002 marginal, else none)."""
    w = Window.partitionBy("tipo").orderBy(F.col("r2_test").desc_nulls_last(), F.col("modelo"))
    best = cmp.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
    b = best.where(F.col("tipo") == BASELINE).select(F.col("modelo").alias("best_baseline"),
                                                     F.col("r2_test").alias("b_r2"), F.col("rmse_test").alias("b_rmse"))
    a = best.where(F.col("tipo") == ADVANCED).select(F.col("modelo").alias("best_advanced"),
                                                     F.col("r2_test").alias("a_r2"), F.col("rmse_test").alias("a_rmse"))
    j = b.crossJoin(a)
    d_r2 = F.col("a_r2") - F.col("b_r2")
    d_rmse = F.col("b_rmse") - F.col("a_rmse")
    verdict = F.when(d_r2 > SIGNIFICANT, "significant").when(d_r2 > MARGINAL, "marginal").otherwise("none")
    return j.select("best_baseline", "best_advanced", F.round(d_r2, 6).alias("delta_r2"),
                    F.round(d_r2 / F.col("b_r2") * 100, 4).alias("delta_r2_pct"),
                    F.round(d_rmse, 2).alias("delta_rmse"),
                    F.round(d_rmse / F.col("b_rmse") * 100, 4).alias("delta_rmse_pct"), verdict.alias("verdict"))


RANK_COLS = ["modelo", "tipo", "r2", "rmse", "mae", "r2_cv_mean", "r2_cv_std", "rmse_cv_mean", "r2_ci_lower", "r2_ci_upper",
             "rmse_ci_lower", "rmse_ci_upper", "mae_ci_lower", "mae_ci_upper"]


def ranking_records(baselines: DataFrame | None, advanced: DataFrame | None = None) -> DataFrame:
    """One record per model.  ``baselines`` (modelo, r2, rmse, mae and their
    bootstrap intervals) have no cross-validation; ``advanced`` is a comparison
    table, whose R2 and RMSE intervals are those of the cross-validation (MAE
    has none there)."""
    parts = []
    if baselines is not None:
        parts.append(baselines.withColumn("tipo", F.lit(BASELINE)))
    if advanced is not None:
        parts.append(advanced.select("modelo", F.lit(ADVANCED).alias("tipo"), F.col("r2_test").alias("r2"), F.col("rmse_test").alias("rmse"),
                                     F.col("mae_test").alias("mae"), "r2_cv_mean", "r2_cv_std", "rmse_cv_mean",
                                     *[F.col(f"{m}_cv_ci_{e}").alias(f"{m}_ci_{e}") for m in ("r2", "rmse") for e in ("lower", "upper")]))
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in RANK_COLS])


def final_ranking(records: DataFrame) -> DataFrame:
    """Records ranked by test R^2, with the text of its interval and
    where the interval comes from."""
    w = Window.orderBy(F.col("r2").desc_nulls_last(), F.col("modelo"))   # a handful of model rows
    known = F.col("r2_ci_lower").isNotNull() & F.col("r2_ci_upper").isNotNull()
    source = F.when(~known, "none").when(F.col("r2_cv_mean").isNotNull(), "CV").otherwise("Bootstrap")
    return records.select(F.row_number().over(w).alias("rank"), "modelo", "tipo",
                          *[F.round(c, 6 if c.startswith("r2") else 2).alias(c) for c in RANK_COLS[2:]],
                          interval_text(F.col("r2"), F.col("r2_ci_lower"), F.col("r2_ci_upper")).alias("r2_text"),
                          source.alias("ci_source"))


def error_bars(records: DataFrame) -> DataFrame:
    """(modelo, metric, value, value - lower, upper - value) where an interval is known."""
    bars = [F.struct(F.lit(m.upper()).alias("metric"), F.round(m, d).alias("value"), F.round(F.col(m) - F.col(f"{m}_ci_lower"), d).alias("err_minus"),
                     F.round(F.col(f"{m}_ci_upper") - F.col(m), d).alias("err_plus")) for m, d in (("r2", 6), ("rmse", 2), ("mae", 2))]
    return records.select("modelo", F.explode(F.array(*bars)).alias("b")).select("modelo", "b.*").where("err_minus is not null and err_plus is not null")


def best_model_card(ranking: DataFrame) -> DataFrame:
    """The top record (one row), found by aggregation, not a sort."""
    rec = F.struct(*[F.col(c) for c in ranking.columns])
    return ranking.agg(F.min_by(rec, F.col("rank")).alias("b")).select("b.*")


def overfit_gap(r2_train, r2_test):
    """(R^2 train - R^2 test) / R^2 train * 100, 0 when R^2 train <= 0."""
    return F.when(r2_train > 0, (r2_train - r2_test) / r2_train * 100).otherwise(F.lit(0.0))
