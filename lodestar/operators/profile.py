"""Profiling operators (survey 2D).

Whole-table profiles are single-pass aggregations (partial aggregates per task,
one tiny final merge) reshaped with ``stack``.  Exact quantiles are selected
between sketched brackets (``selection``): no sort, nothing row-sized shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.selection import select_quantiles


def _stack(df: DataFrame, names: list[str], value_cols: dict[str, list[str]], label: str) -> DataFrame:
    """Wide one-row-per-group frame -> long, one row per name."""
    n = len(names)
    outs = list(value_cols)
    parts = []
    for i, name in enumerate(names):
        parts.append(f"'{name}'")
        parts.extend(f"`{value_cols[o][i]}`" for o in outs)
    expr = f"stack({n}, {', '.join(parts)}) AS ({label}, {', '.join(outs)})"
    keep = [c for c in df.columns if not any(c in v for v in value_cols.values())]
    return df.selectExpr(*[f"`{c}`" for c in keep], expr)


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: null count and percentage of rows (long form)."""
    cols = cols or df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("bigint").alias(f"__n_{c}") for c in cols]
    wide = df.agg(*aggs)
    long = _stack(wide, cols, {"n_null": [f"__n_{c}" for c in cols]}, "column_name")
    return long.select("column_name", "n_null",
                       F.round(F.col("n_null") * 100.0 / F.col("__rows"), 4).alias("pct_null"))


def completeness(df: DataFrame) -> DataFrame:
    """Shape and percentage of non-null cells, one pass."""
    cols = df.columns
    nonnull = sum((F.count(F.col(c)) for c in cols), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), nonnull.cast("bigint").alias("n_nonnull")).select(
        "n_rows", F.lit(len(cols)).cast("bigint").alias("n_cols"),
        (F.col("n_rows") * len(cols)).alias("n_cells"), "n_nonnull",
        F.round(F.col("n_nonnull") * 100.0 / (F.col("n_rows") * len(cols)), 4).alias("pct_complete"))


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
              exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Quantiles with linear interpolation, per group if ``by``.

    Output: by..., ``p_index`` (position in ``probs``), ``q``.  The exact path
    selects (two passes over the column, see ``selection``); ``exact=False``
    uses the bounded-memory ``percentile_approx`` sketch alone.
    """
    by = by or []
    if exact:
        return select_quantiles(df, value, probs, by)
    base = df.select(*by, value).where(F.col(value).isNotNull())
    approx = base.groupBy(*by).agg(F.percentile_approx(value, probs, accuracy).alias("__qs"))
    return approx.select(*by, F.posexplode("__qs").alias("p_index", "q"))


def quantiles_wide(df: DataFrame, value: str, probs: list[float], names: list[str],
                   by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Quantiles as named columns, one row per group."""
    by = by or []
    long = quantiles(df, value, probs, by, exact)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("p_index") == i, F.col("q"))).alias(nm)
                                   for i, nm in enumerate(names)])


def describe(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """Count, mean, sample sd, min, quartiles, max per numeric column."""
    moments = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"count__{c}"), F.avg(c).alias(f"mean__{c}"), F.stddev_samp(c).alias(f"std__{c}"),
        F.min(F.col(c).cast("double")).alias(f"min__{c}"), F.max(F.col(c).cast("double")).alias(f"max__{c}"))])
    stats = ["count", "mean", "std", "min", "max"]
    long = _stack(moments, cols, {s: [f"{s}__{c}" for c in cols] for s in stats}, "column_name")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("__x"))
                                           for c in cols])).alias("__s")).select("__s.column_name", "__s.__x")
    qs = quantiles_wide(values, "__x", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], by=["column_name"])
    out = long.join(qs, "column_name")
    return out.select("column_name", "count", *[F.round(c, digits).alias(c) for c in
                                                ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def value_counts(df: DataFrame, col: str, keep_null: bool, digits: int = 6) -> DataFrame:
    """Counts per value, share over ALL rows, sorted by count desc, value.

    The total is a one-row aggregate broadcast to the grouped counts.
    """
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    base = df if keep_null else df.where(F.col(col).isNotNull())
    counts = base.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return (counts.crossJoin(F.broadcast(total))
            .select(col, "n", F.round(F.col("n") / F.col("__total"), digits).alias("share"))
            .orderBy(F.col("n").desc(), F.col(col).asc_nulls_last()))


def singleton_fragmentation(df: DataFrame, col: str) -> DataFrame:
    """Distinct values, values seen once, and their share of the distinct."""
    per = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    return per.agg(F.count(F.lit(1)).alias("n_distinct"),
                   F.sum(F.when(F.col("__n") == 1, 1).otherwise(0)).cast("bigint").alias("n_singletons")) \
        .withColumn("pct_singletons", F.round(F.col("n_singletons") * 100.0 / F.col("n_distinct"), 4))


def group_mean(df: DataFrame, by: str, value: str, digits: int = 2, out: str = "mean_value") -> DataFrame:
    """Group mean, rounded, sorted descending."""
    return df.groupBy(by).agg(F.round(F.avg(value), digits).alias(out)).orderBy(F.col(out).desc(), F.col(by))


def crosstab_margins(df: DataFrame, a: str, b: str, margin: str = "All") -> DataFrame:
    """Crosstab with margins in long form (a, b, n); null pairs dropped.

    CUBE computes the cells, the row/column totals and the grand total in one
    aggregation; ``grouping()`` tells margin rows from real values.
    """
    base = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cube = base.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("__ga"),
                               F.grouping(b).alias("__gb"))
    return cube.select(F.when(F.col("__ga") == 1, F.lit(margin)).otherwise(F.col(a)).alias(a),
                       F.when(F.col("__gb") == 1, F.lit(margin)).otherwise(F.col(b)).alias(b), "n")


def multi_measure(df: DataFrame, by: str, measures: list[str], digits: int = 3) -> DataFrame:
    """mean/max/min of several measures per group, rounded."""
    aggs = []
    for m in measures:
        aggs += [F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.max(m), digits).alias(f"{m}_max"),
                 F.round(F.min(m), digits).alias(f"{m}_min")]
    return df.groupBy(by).agg(*aggs)


def flag_totals(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Count of true values per boolean expression."""
    return df.agg(*[F.count_if(e).alias(name) for name, e in flags.items()])
