"""Step 4: engineered features and text/JSON functions (2H)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import features as fx
from lodestar.plans.facts import FACTS_SQL, facts, with_sql
from lodestar.plans.registry import query
from lodestar.sources.tables import read_table

# The order table mapped onto the reference's feature inputs:
# age <- qty, years of experience <- n_lines, education <- priority code.
PRIORITY_AS_EDUCATION = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}


def engineered_frame(f):
    exp = F.col("n_lines").cast("double")
    age = F.col("qty")
    edu = fx.literal_map(PRIORITY_AS_EDUCATION, F.col("priority"))
    cols = fx.engineered(age, exp, edu)
    return f.select("id", *[(F.round(c, 6) if name != "education_numerica" else c).alias(name)
                            for name, c in cols.items()])


_ENG_SQL = with_sql(FACTS_SQL) + """,
b AS (SELECT id, qty AS age, CAST(n_lines AS DOUBLE) AS ex,
             CASE priority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS edu
      FROM facts)
SELECT id,
  ROUND(age - ex, 6) AS inicio_laboral,
  ROUND(ex / NULLIF(age, 0), 6) AS ratio_experiencia,
  ROUND(ex / NULLIF(age - 22.0, 0), 6) AS ratio_velocidad_carrera,
  ROUND(ex * ex, 6) AS experience2,
  ROUND(ex * ex * ex, 6) AS experience3,
  ROUND(age * ex, 6) AS edad_x_experiencia,
  ROUND(age * (ex * ex), 6) AS edad_x_experiencia2,
  ROUND(CASE WHEN ex = 0 THEN 0.0 ELSE ln(1.0 + ex) END, 6) AS log_experiencia,
  edu AS education_numerica,
  ROUND(edu * ex, 6) AS educacion_x_experiencia
FROM b"""


@query("engineered_numeric", _ENG_SQL)
def engineered_numeric(spark, sf):
    """H1-H8: arithmetic features, guarded ratios, log feature, ordinal map."""
    return engineered_frame(facts(spark, sf))


@query("engineered_concat", with_sql(FACTS_SQL) + """
SELECT id, segment || '_' || NULLIF(priority, '5-LOW') AS segment_priority FROM facts""")
def engineered_concat(spark, sf):
    """H9: null-propagating concatenation of two categories."""
    f = facts(spark, sf)
    return f.select("id", fx.null_concat(F.col("segment"), F.nullif(F.col("priority"), F.lit("5-LOW")))
                    .alias("segment_priority"))


@query("text_newline_clean", """
SELECT doc_id, replace(text, chr(10), ' ') AS text_clean,
       CAST(length(replace(text, chr(10), ' ')) AS INTEGER) AS n_chars_clean FROM documents""")
def text_newline_clean(spark, sf):
    """Newline -> space over whole texts."""
    docs = read_table(spark, sf, "documents")
    clean = fx.newline_to_space(F.col("text"))
    return docs.select("doc_id", clean.alias("text_clean"), F.length(clean).alias("n_chars_clean"))


REPLY_SCHEMA = T.StructType([T.StructField("k", T.IntegerType())])


@query("json_reply_parse", """
SELECT event_id, event_type,
       TRY_CAST(json_extract_string(regexp_replace(regexp_replace(regexp_replace(regexp_replace(props, '^\\s+|\\s+$', '', 'g'),
                '^```(json)?', ''), '```$', ''), '^\\s+|\\s+$', '', 'g'), '$.k')
                AS INTEGER) AS k
FROM events""")
def json_reply_parse(spark, sf):
    """Fence strip + JSON decode with a declared schema."""
    ev = read_table(spark, sf, "events")
    parsed = F.from_json(fx.strip_code_fence(F.col("props")), REPLY_SCHEMA)
    return ev.select("event_id", "event_type", parsed.getField("k").alias("k"))


@query("linear_grid", with_sql(FACTS_SQL) + """,
m AS (SELECT MIN(total) AS lo, MAX(total) AS hi FROM facts)
SELECT CAST(r.range AS BIGINT) AS i, ROUND(lo + (hi - lo) * CAST(r.range AS DOUBLE) / 99.0, 4) AS x
FROM m, range(100) r""")
def linear_grid(spark, sf):
    """100-point linspace over the observed range of a column."""
    m = facts(spark, sf).agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    grid = spark.range(100).withColumnRenamed("id", "i")
    return grid.crossJoin(F.broadcast(m)).select(
        "i", F.round(fx.linspace_expr(F.col("lo"), F.col("hi"), F.col("i"), 100), 4).alias("x"))


@query("interval_text", with_sql(FACTS_SQL) + """,
s AS (SELECT priority, AVG(total) AS m, STDDEV_SAMP(total) AS sd, COUNT(*) AS n FROM facts GROUP BY priority),
c AS (SELECT priority, m, m - 1.959963984540054 * sd / sqrt(n) AS lo, m + 1.959963984540054 * sd / sqrt(n) AS hi FROM s)
SELECT priority,
  CASE WHEN m IS NULL THEN 'N/A'
       WHEN lo IS NULL OR hi IS NULL THEN printf('%.3f', ROUND(m, 3)) || ' (No IC)'
       ELSE printf('%.3f (%.3f-%.3f)', ROUND(m, 3), ROUND(lo, 3), ROUND(hi, 3)) END AS mean_ci_text
FROM c""")
def interval_text(spark, sf):
    """H20: 'value (lo-hi)' text for a mean and its normal 95 % interval."""
    s = facts(spark, sf).groupBy("priority").agg(F.avg("total").alias("m"), F.stddev_samp("total").alias("sd"),
                                                 F.count(F.lit(1)).alias("n"))
    half = F.lit(1.959963984540054) * F.col("sd") / F.sqrt("n")
    return s.select("priority", fx.interval_text(F.col("m"), F.col("m") - half, F.col("m") + half)
                    .alias("mean_ci_text"))


@query("clip_values", with_sql(FACTS_SQL) + """
SELECT id, greatest(30000.0, least(200000.0, total)) AS total, total < 30000 OR total > 200000 AS clipped FROM facts""")
def clip_values(spark, sf):
    """The target clipped to the reference's salary range."""
    out = F.col("total") < 30000
    return facts(spark, sf).select("id", fx.clip(F.col("total"), 30000.0, 200000.0).alias("total"), (out | (F.col("total") > 200000)).alias("clipped"))
