"""Step 2: profiling (2D) and top-k (2F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import ordering as od
from lodestar.operators import profile as pf
from lodestar.plans.facts import DOCLAB_SQL, FACTS_SQL, doclab, facts, with_sql
from lodestar.plans.registry import query
from lodestar.sources.tables import read_table

DOC_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
NUM_COLS = ["n_lines", "qty", "total"]


def _null_sql():
    parts = [f"SELECT '{c}' AS column_name, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, "
             f"ROUND(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 4) AS pct_null FROM doclab"
             for c in DOC_COLS]
    return with_sql(DOCLAB_SQL) + "\nUNION ALL\n".join(parts)


@query("null_profile", _null_sql())
def null_profile(spark, sf):
    return pf.null_profile(doclab(spark, sf), DOC_COLS)


@query("completeness", with_sql(DOCLAB_SQL) + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST({len(DOC_COLS)} AS BIGINT) AS n_cols,
       CAST(COUNT(*) * {len(DOC_COLS)} AS BIGINT) AS n_cells,
       CAST({' + '.join(f'COUNT({c})' for c in DOC_COLS)} AS BIGINT) AS n_nonnull,
       ROUND(({' + '.join(f'COUNT({c})' for c in DOC_COLS)}) * 100.0 / (COUNT(*) * {len(DOC_COLS)}), 4) AS pct_complete
FROM doclab""")
def completeness(spark, sf):
    return pf.completeness(doclab(spark, sf).select(*DOC_COLS))


def _describe_sql():
    parts = [f"""SELECT '{c}' AS column_name, CAST(COUNT({c}) AS BIGINT) AS count, ROUND(AVG({c}), 4) AS mean,
       ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(MIN({c}), 4) AS min,
       ROUND(QUANTILE_CONT({c}, 0.25), 4) AS p25, ROUND(QUANTILE_CONT({c}, 0.5), 4) AS p50,
       ROUND(QUANTILE_CONT({c}, 0.75), 4) AS p75, ROUND(MAX({c}), 4) AS max FROM facts""" for c in NUM_COLS]
    return with_sql(FACTS_SQL) + "\nUNION ALL\n".join(parts)


@query("describe_numeric", _describe_sql())
def describe_numeric(spark, sf):
    return pf.describe(facts(spark, sf), NUM_COLS)


@query("quartiles_iqr", with_sql(FACTS_SQL) + """
SELECT ROUND(QUANTILE_CONT(total, 0.25), 4) AS q1, ROUND(QUANTILE_CONT(total, 0.5), 4) AS median,
       ROUND(QUANTILE_CONT(total, 0.75), 4) AS q3,
       ROUND(QUANTILE_CONT(total, 0.75) - QUANTILE_CONT(total, 0.25), 4) AS iqr FROM facts""")
def quartiles_iqr(spark, sf):
    q = pf.quantiles_wide(facts(spark, sf), "total", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return q.select(F.round("q1", 4).alias("q1"), F.round("median", 4).alias("median"),
                    F.round("q3", 4).alias("q3"), F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"))


@query("value_counts_null", with_sql(DOCLAB_SQL) + """
SELECT quality, CAST(COUNT(*) AS BIGINT) AS n,
       ROUND(COUNT(*) / (SELECT COUNT(*) FROM doclab), 6) AS share
FROM doclab GROUP BY quality""")
def value_counts_null(spark, sf):
    return pf.value_counts(doclab(spark, sf), "quality", keep_null=True)


@query("value_counts_nonnull", with_sql(DOCLAB_SQL) + """
SELECT toxic, CAST(COUNT(*) AS BIGINT) AS n,
       ROUND(COUNT(*) / (SELECT COUNT(*) FROM doclab), 6) AS share
FROM doclab WHERE toxic IS NOT NULL GROUP BY toxic""")
def value_counts_nonnull(spark, sf):
    return pf.value_counts(doclab(spark, sf), "toxic", keep_null=False)


@query("singleton_fragmentation", """
SELECT CAST(COUNT(*) AS BIGINT) AS n_distinct,
       CAST(SUM(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_singletons,
       ROUND(SUM(CASE WHEN n = 1 THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 4) AS pct_singletons
FROM (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey)""")
def singleton_fragmentation(spark, sf):
    return pf.singleton_fragmentation(read_table(spark, sf, "lineitem"), "l_partkey")


@query("group_mean_sorted", with_sql(FACTS_SQL) + """
SELECT priority, ROUND(AVG(total), 2) AS mean_value FROM facts GROUP BY priority""")
def group_mean_sorted(spark, sf):
    return pf.group_mean(facts(spark, sf), "priority", "total")


@query("crosstab_margins", with_sql(FACTS_SQL) + """
SELECT CASE WHEN GROUPING(priority) = 1 THEN 'All' ELSE priority END AS priority,
       CASE WHEN GROUPING(segment) = 1 THEN 'All' ELSE segment END AS segment,
       CAST(COUNT(*) AS BIGINT) AS n
FROM facts WHERE priority IS NOT NULL AND segment IS NOT NULL GROUP BY CUBE (priority, segment)""")
def crosstab_margins(spark, sf):
    return pf.crosstab_margins(facts(spark, sf), "priority", "segment")


def _multi_sql():
    cols = ", ".join(f"ROUND(AVG({m}), 3) AS {m}_mean, ROUND(MAX(CAST({m} AS DOUBLE)), 3) AS {m}_max, "
                     f"ROUND(MIN(CAST({m} AS DOUBLE)), 3) AS {m}_min" for m in NUM_COLS)
    return with_sql(FACTS_SQL) + f"SELECT segment, {cols} FROM facts GROUP BY segment"


@query("multi_measure_by_type", _multi_sql())
def multi_measure_by_type(spark, sf):
    f = facts(spark, sf).withColumn("n_lines", F.col("n_lines").cast("double"))
    return pf.multi_measure(f, "segment", NUM_COLS)


@query("flag_totals", with_sql(DOCLAB_SQL) + """
SELECT CAST(COUNT_IF(quality = 1) AS BIGINT) AS n_quality, CAST(COUNT_IF(toxic = 1) AS BIGINT) AS n_toxic,
       CAST(COUNT_IF(quality IS NOT NULL) AS BIGINT) AS n_labeled,
       CAST(COUNT_IF(n_chars > 5000) AS BIGINT) AS n_long FROM doclab""")
def flag_totals(spark, sf):
    return pf.flag_totals(doclab(spark, sf), {
        "n_quality": F.col("quality") == 1, "n_toxic": F.col("toxic") == 1,
        "n_labeled": F.col("quality").isNotNull(), "n_long": F.col("n_chars") > 5000})


@query("top5_low", with_sql(FACTS_SQL) + """
SELECT id, total, segment FROM facts WHERE total IS NOT NULL ORDER BY total ASC, id ASC LIMIT 5""")
def top5_low(spark, sf):
    return od.smallest(facts(spark, sf), "total", 5, "id").select("id", "total", "segment")


@query("top5_high", with_sql(FACTS_SQL) + """
SELECT id, total, segment FROM facts WHERE total IS NOT NULL ORDER BY total DESC, id ASC LIMIT 5""")
def top5_high(spark, sf):
    return od.smallest(facts(spark, sf), "total", 5, "id", largest=True).select("id", "total", "segment")
