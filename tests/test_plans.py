"""Plan shapes that matter at scale (checked on the physical plan text)."""

from pyspark.sql import functions as F

from lodestar.operators import enrich as en
from lodestar.operators import resample as rs
from lodestar.plans.facts import facts_plan
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_working_table_prunes_columns_and_aggregates_before_the_shuffle(spark):
    p = _plan(facts_plan(spark, SF_SMALL))
    assert "partial_sum" in p and "partial_count" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in p


def test_replicates_are_spread_before_the_explode(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.rand(1).alias("v"))
    w = rs.replicate_weights(df, "k", 10)
    p = _plan(w.groupBy("rep").agg(F.sum(F.col("w") * F.col("v"))))
    assert "RoundRobinPartitioning" in p
    assert p.count("md5") == 1                 # one hash per row, not per replicate


def test_description_rules_cut_each_text_once(spark):
    docs = spark.createDataFrame([(1, "senior engineer")], "id int, text string")
    p = _plan(en.describe_text(docs, "id", "text"))
    assert p.count("split(") == 1 and "regexp_extract_all" not in p


def test_working_table_is_materialised_once(spark):
    from lodestar.plans.facts import facts
    first = facts(spark, SF_SMALL)
    again = facts(spark, SF_SMALL)
    p = _plan(again)
    # a plain scan of the stored per-order table (plan text truncates long paths)
    assert "lineitem" not in p and "Exchange" not in p
    assert "ReadSchema: struct<id:bigint,n_lines:bigint,qty:double,total:double" in p
    assert first.count() == again.count() == facts_plan(spark, SF_SMALL).count()


def test_quantiles_read_one_column_and_sort_no_rows(spark, tmp_path):
    """Two passes over (group, value): no range exchange, no window or sort below
    the first aggregation, nothing row-sized in an exchange."""
    from lodestar.operators import profile as pf
    facts_plan(spark, SF_SMALL).write.parquet(str(tmp_path / "t"))
    f = spark.read.parquet(str(tmp_path / "t"))
    p = _plan(pf.quantiles(f, "total", [0.25, 0.5, 0.75], by=["segment"]))
    assert "rangepartitioning" not in p.lower()
    scans = [line for line in p.splitlines() if "FileScan parquet" in line]
    assert scans and all("ReadSchema: struct<total:double,segment:string>" in line for line in scans)
    for line in scans:
        above = p[:p.index(line)].splitlines()[::-1]
        first = next(x for x in above if "Exchange hashpartitioning" in x or "partial_count" in x)
        assert "partial_count" in first           # aggregated before the first shuffle of a row
