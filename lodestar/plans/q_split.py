"""Step 6: split, folds, batches, scaling and encoding (2I, 2E, 2J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.hashing import sql_hash_u32, sql_hash_uniform
from lodestar.operators import ordering as od
from lodestar.operators import resample as rs
from lodestar.operators import transform as tf
from lodestar.plans.facts import FACTS_SQL, facts, with_sql
from lodestar.plans.registry import query
from lodestar.sources.tables import read_table

NUM = ["n_lines", "qty", "total"]
TEST_FRACTION = 0.2

U_SPLIT = sql_hash_uniform("id", "'split42'")
SPLIT_SQL = f"""split AS (SELECT *, {U_SPLIT} < 0.2 AS is_test FROM facts)"""


def split_facts(spark, sf):
    f = facts(spark, sf)
    return f.withColumn("is_test", rs.split_flag("id", TEST_FRACTION))


@query("train_test_split", with_sql(FACTS_SQL, SPLIT_SQL) + """
SELECT id, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split FROM split""")
def train_test_split(spark, sf):
    """Keyed hash split (test 20 %, seed 42)."""
    return split_facts(spark, sf).select("id", F.when(F.col("is_test"), "test").otherwise("train").alias("split"))


@query("kfold_hash", with_sql(FACTS_SQL) + f"""
SELECT id, CAST({sql_hash_u32('id', "'fold42'")} % 5 AS INTEGER) AS fold FROM facts""")
def kfold_hash(spark, sf):
    """Shuffled 5-fold ids."""
    return facts(spark, sf).select("id", rs.hash_fold("id", 5).alias("fold"))


@query("kfold_contiguous", with_sql(FACTS_SQL) + """
SELECT id, CAST(NTILE(5) OVER (ORDER BY id) - 1 AS INTEGER) AS fold FROM facts""")
def kfold_contiguous(spark, sf):
    """Contiguous folds in key order, exact NTILE without a global window."""
    return rs.with_folds(facts(spark, sf).select("id"), "id", 5, contiguous=True)


@query("batch_index", """
SELECT p_name, CAST((ROW_NUMBER() OVER (ORDER BY p_name) - 1) // 5 AS BIGINT) AS batch_id,
       CAST((ROW_NUMBER() OVER (ORDER BY p_name) - 1) % 5 AS INTEGER) AS pos
FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)""")
def batch_index(spark, sf):
    """Batches of 5 over the distinct titles in sorted order."""
    titles = read_table(spark, sf, "part").select("p_name").na.drop().distinct()
    return od.batch_number(titles, ["p_name"], 5)


SEGMENTS_AFTER_FIRST = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", with_sql(FACTS_SQL) + "SELECT id, " + ", ".join(
    f"CAST(segment = '{s}' AS DOUBLE) AS segment_{s}" for s in SEGMENTS_AFTER_FIRST) + " FROM facts")
def one_hot(spark, sf):
    """One-hot with the alphabetically first category dropped."""
    df, names = tf.one_hot_drop_first(facts(spark, sf).select("id", "segment"), "segment")
    return df.select("id", *names)


@query("label_encode", with_sql(FACTS_SQL) + """
SELECT id, priority, CAST(DENSE_RANK() OVER (ORDER BY priority) - 1 AS DOUBLE) AS priority_idx FROM facts""")
def label_encode(spark, sf):
    """Sorted classes -> 0..k-1."""
    return tf.label_encode(facts(spark, sf).select("id", "priority"), "priority")


def _scale_sql(center: str, scale: str) -> str:
    params = ", ".join(f"{center.format(c=c)} AS c_{c}, {scale.format(c=c)} AS s_{c}" for c in NUM)
    cols = ", ".join(f"ROUND((CAST({c} AS DOUBLE) - c_{c}) / NULLIF(s_{c}, 0), 6) AS {c}" for c in NUM)
    return with_sql(FACTS_SQL, SPLIT_SQL) + f""",
p AS (SELECT {params} FROM split WHERE NOT is_test)
SELECT id, {cols} FROM split, p"""


def _scaled(spark, sf, method):
    f = split_facts(spark, sf)
    sc = tf.Scaler(NUM, method).fit(f.where(~F.col("is_test")))
    out = sc.transform(f.select("id", *NUM))
    return out.select("id", *[F.round(c, 6).alias(c) for c in NUM])


@query("standard_scale", _scale_sql("AVG({c})", "STDDEV_POP({c})"))
def standard_scale(spark, sf):
    """Z-score with population sd, fitted on the training split only."""
    return _scaled(spark, sf, "standard")


@query("robust_scale", _scale_sql("QUANTILE_CONT({c}, 0.5)", "QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25)"))
def robust_scale(spark, sf):
    """(x - median) / IQR, fitted on the training split."""
    return _scaled(spark, sf, "robust")


@query("minmax_scale", _scale_sql("MIN(CAST({c} AS DOUBLE))", "CAST(MAX({c}) - MIN({c}) AS DOUBLE)"))
def minmax_scale(spark, sf):
    """(x - min) / (max - min), fitted on the training split."""
    return _scaled(spark, sf, "minmax")


def _quantile_normal_sql(n: int = 100, bound: float = 1e-7) -> str:
    from lodestar.functions.hashing import sql_double
    from lodestar.functions.stats import sql_inv_normal
    probs = ", ".join(sql_double(i / (n - 1)) for i in range(n))
    p_raw = (f"((lo_i - 1 + greatest(0.0e0, least(1.0e0, CASE WHEN g_hi > g_lo THEN (x - g_lo) / (g_hi - g_lo) "
             f"ELSE 0.0e0 END))) / {float(n - 1):.17e})")
    return with_sql(FACTS_SQL, SPLIT_SQL) + f""",
gq AS (SELECT quantile_cont(total, [{probs}]) AS g FROM split WHERE NOT is_test),
gl AS (SELECT UNNEST(g) AS q FROM gq),
c AS (SELECT s.id, s.total, CAST(s.total AS DOUBLE) AS x,
             (SELECT COUNT(*) FROM gl WHERE gl.q <= CAST(s.total AS DOUBLE)) AS cnt FROM split s),
i AS (SELECT c.*, greatest(1, least(cnt, {n - 1})) AS lo_i FROM c),
v AS (SELECT i.*, gq.g[lo_i] AS g_lo, gq.g[lo_i + 1] AS g_hi FROM i, gq),
p AS (SELECT id, total, greatest({bound:.17e}, least({1 - bound:.17e}, {p_raw})) AS p FROM v)
SELECT id, total, ROUND({sql_inv_normal('p')}, 6) AS total_qn FROM p"""


@query("quantile_normal", _quantile_normal_sql())
def quantile_normal(spark, sf):
    """Quantile-to-normal map (100 training quantiles, Phi^-1)."""
    f = split_facts(spark, sf)
    out = tf.quantile_normal(f.where(~F.col("is_test")), f.select("id", "total"), "total")
    return out.select("id", "total", F.round("total_qn", 6).alias("total_qn"))


@query("scale_inverse", with_sql(FACTS_SQL) + "SELECT id, " + ", ".join(
    f"ROUND(CAST({c} AS DOUBLE), 4) AS {c}" for c in NUM) + " FROM facts")
def scale_inverse(spark, sf):
    """inverse(transform(x)) == x (robust scaler, fitted on train)."""
    f = split_facts(spark, sf)
    sc = tf.Scaler(NUM, "robust").fit(f.where(~F.col("is_test")))
    back = sc.inverse_transform(sc.transform(f.select("id", *[F.col(c).cast("double").alias(c) for c in NUM])))
    return back.select("id", *[F.round(c, 4).alias(c) for c in NUM])
