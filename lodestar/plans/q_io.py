"""Step 1: sources, sinks, set operations and the unifying join (2A, 2C C1, 2G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import relational as rel
from lodestar.plans.facts import FACTS_SQL, facts, with_sql
from lodestar.plans.registry import query
from lodestar.session import scratch_path
from lodestar.sources import tables as io


@query("common_ids", """
SELECT CAST(COUNT(*) AS BIGINT) AS n_common FROM (
  SELECT o_orderkey AS k FROM orders
  INTERSECT SELECT l_orderkey FROM lineitem
  INTERSECT SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))""")
def common_ids(spark, sf):
    """Key-integrity check -- order keys present in orders, in lineitem,
    and whose customer exists (3-way distinct INTERSECT, counted)."""
    orders = io.read_table(spark, sf, "orders")
    lines = io.read_table(spark, sf, "lineitem")
    cust = io.read_table(spark, sf, "customer")
    valid = orders.join(cust, orders.o_custkey == cust.c_custkey, "left_semi").select("o_orderkey")
    return rel.count_common_keys([orders.select("o_orderkey"), lines.select("l_orderkey"), valid],
                                 out="n_common")


@query("unified_join", with_sql(FACTS_SQL) + "SELECT * FROM facts")
def unified_join(spark, sf):
    """The 3-way inner join on the order key, projected and renamed."""
    return facts(spark, sf)


@query("ctas_roundtrip", with_sql(FACTS_SQL) + """
SELECT segment, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(total), 2) AS total
FROM facts GROUP BY segment""")
def ctas_roundtrip(spark, sf):
    """Register a view, CREATE TABLE AS SELECT, scan it back."""
    facts(spark, sf).createOrReplaceTempView("facts_view")
    name = "lodestar_ctas_by_segment"
    stored = io.create_table_as(spark, name, """
        SELECT segment, COUNT(*) AS n, ROUND(SUM(total), 2) AS total
        FROM facts_view GROUP BY segment""")
    return io.run_sql(spark, f"SELECT * FROM {name}")


@query("csv_roundtrip", with_sql(FACTS_SQL) + "SELECT * FROM facts")
def csv_roundtrip(spark, sf):
    """CSV sink to the shared scratch folder and typed read-back."""
    return io.csv_roundtrip(facts(spark, sf), "facts-csv")


@query("union_records", with_sql(FACTS_SQL) + """
SELECT 'segment:' || segment AS modelo, ROUND(regr_r2(total, n_lines), 6) AS r2,
       CAST(COUNT(*) AS BIGINT) AS n FROM facts GROUP BY segment
UNION ALL BY NAME
SELECT 'priority:' || priority AS modelo, ROUND(regr_slope(total, n_lines), 4) AS slope,
       'priority' AS tipo FROM facts GROUP BY priority""")
def union_records(spark, sf):
    """Append result records whose column sets differ (missing -> null)."""
    f = facts(spark, sf)
    a = f.groupBy("segment").agg(F.round(F.regr_r2("total", "n_lines"), 6).alias("r2"),
                                 F.count(F.lit(1)).alias("n")) \
        .select(F.concat(F.lit("segment:"), "segment").alias("modelo"), "r2", "n")
    b = f.groupBy("priority").agg(F.round(F.regr_slope("total", "n_lines"), 4).alias("slope")) \
        .select(F.concat(F.lit("priority:"), "priority").alias("modelo"), "slope",
                F.lit("priority").alias("tipo"))
    return rel.union_records([a, b])


@query("distinct_titles", """
SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL""")
def distinct_titles(spark, sf):
    """Distinct non-null titles."""
    return rel.distinct_non_null(io.read_table(spark, sf, "part"), "p_name")


@query("csv_load", with_sql(FACTS_SQL) + """
SELECT 'loaded' AS part, segment, COUNT(*) AS n, ROUND(SUM(total), 2) AS total FROM facts WHERE id % 97 <> 0 GROUP BY segment
UNION ALL SELECT 'rejected', NULL, COUNT(*), NULL FROM facts WHERE id % 97 = 0
UNION ALL SELECT 'raw', segment, COUNT(*), NULL FROM facts WHERE id % 97 = 0 GROUP BY segment""")
def csv_load(spark, sf):
    """A1: a CSV some of whose lines do not fit the schema (a word for a number)
    is loaded as a table; the lines that do not fit are kept in a second one."""
    f = facts(spark, sf)
    lines = f.select("id", "n_lines", F.when(F.col("id") % 97 == 0, F.lit("many")).otherwise(F.col("qty").cast("string")).alias("qty"), "total", "priority", "segment")
    path = io.write_csv(lines, scratch_path(spark, "facts-lines"))
    loaded, rejected = io.load_csv(spark, path, "id bigint, n_lines bigint, qty double, total double, priority string, segment string", "lodestar_csv_load")
    good = loaded.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 2).alias("total"))
    raw = rejected.groupBy(F.element_at(F.split(io.CORRUPT, ","), -1).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("double").alias("total")
    return (good.select(F.lit("loaded").alias("part"), "segment", "n", "total")
            .union(rejected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected"), F.lit(None).cast("string"), "n", none))
            .union(raw.select(F.lit("raw"), "segment", "n", none)))


@query("frame_to_table", with_sql(FACTS_SQL) + """
SELECT priority, COUNT(*) AS n, ROUND(AVG(total), 2) AS mean_total FROM facts GROUP BY priority""")
def frame_to_table(spark, sf):
    """A4: a frame stored as a table (replaced if it is there) and scanned by its name."""
    f = facts(spark, sf).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 2).alias("mean_total"))
    io.frame_to_table(f, "lodestar_frame_by_priority")
    return spark.table("lodestar_frame_by_priority")


@query("optional_source", with_sql(FACTS_SQL) + """
SELECT 'there' AS source, TRUE AS found, COUNT(*) AS n FROM facts UNION ALL SELECT 'missing', FALSE, 0""")
def optional_source(spark, sf):
    """An optional CSV that is there and one that is not."""
    path = io.write_csv(facts(spark, sf).select("id", "total"), scratch_path(spark, "optional"))
    parts = []
    for name, at in (("there", path), ("missing", f"{path}-missing")):
        got = io.read_csv_optional(spark, at, "id bigint, total double")
        rows = spark.createDataFrame([], "id bigint, total double") if got is None else got
        parts.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), F.lit(got is not None).alias("found"), "n"))
    return parts[0].union(parts[1])
