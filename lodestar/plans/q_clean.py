"""Step 3: filters, null handling, point updates and lookups (2B, 2C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.features import literal_map
from lodestar.operators import profile as pf
from lodestar.operators import relational as rel
from lodestar.plans.facts import DOCLAB_SQL, FACTS_SQL, doclab, facts, with_sql
from lodestar.plans.registry import query
from lodestar.sources.tables import read_table

# doclab with a second nullable flag, so "all null" and "any null" differ.
DL2_SQL = """dl2 AS (SELECT doc_id, lang, quality, NULLIF(toxic, 0) AS toxic_flag FROM doclab)"""


def _dl2(spark, sf):
    return doclab(spark, sf).select("doc_id", "lang", "quality", F.nullif(F.col("toxic"), F.lit(0)).alias("toxic_flag"))


@query("rows_any_null", with_sql(DOCLAB_SQL, DL2_SQL) + """
SELECT * FROM dl2 WHERE doc_id IS NULL OR lang IS NULL OR quality IS NULL OR toxic_flag IS NULL""")
def rows_any_null(spark, sf):
    """B2: rows with a null in any column."""
    df = _dl2(spark, sf)
    return df.where(rel.any_null(df.columns))


@query("drop_all_null", with_sql(DOCLAB_SQL, DL2_SQL) + """
SELECT * FROM dl2 WHERE NOT (quality IS NULL AND toxic_flag IS NULL)""")
def drop_all_null(spark, sf):
    """Drop a row only when every column of the subset is null."""
    return _dl2(spark, sf).na.drop("all", subset=["quality", "toxic_flag"])


@query("drop_any_null", with_sql(DOCLAB_SQL, DL2_SQL) + """
SELECT * FROM dl2 WHERE quality IS NOT NULL AND toxic_flag IS NOT NULL""")
def drop_any_null(spark, sf):
    """Drop a row when any column of the subset is null."""
    return _dl2(spark, sf).na.drop("any", subset=["quality", "toxic_flag"])


# Edit list for B6 (imputations fill nulls; the correction overrides a value).
PATCH_IMPUTE = [(0, "quality", "1"), (1, "quality", "0"), (2, "quality", "1"), (3, "toxic", "0"),
                (4, "toxic", "1"), (5, "quality", "0"), (6, "quality", "1"), (7, "toxic", "0")]
PATCH_CORRECT = [(8, "lang", "xx")]


def _patch_sql():
    def case(col, edits, cast):
        whens = " ".join(f"WHEN doc_id = {k} THEN CAST('{v}' AS {cast})" for k, c, v in edits if c == col)
        return f"CASE {whens} END" if whens else "NULL"
    q = f"COALESCE(quality, {case('quality', PATCH_IMPUTE, 'INTEGER')}) AS quality"
    t = f"COALESCE(toxic, {case('toxic', PATCH_IMPUTE, 'INTEGER')}) AS toxic"
    lang = f"COALESCE({case('lang', PATCH_CORRECT, 'VARCHAR')}, lang) AS lang"
    return with_sql(DOCLAB_SQL) + f"SELECT doc_id, {lang}, source, n_chars, {q}, {t} FROM doclab"


@query("patch_impute", _patch_sql())
def patch_impute(spark, sf):
    """Keyed point updates from a patch table (impute, then correct)."""
    schema = "doc_id bigint, column string, value string"
    imputes = spark.createDataFrame(PATCH_IMPUTE, schema)
    corrections = spark.createDataFrame(PATCH_CORRECT, schema)
    df = rel.apply_patches(doclab(spark, sf), imputes, "doc_id")
    return rel.apply_patches(df, corrections, "doc_id", override=True)


@query("regex_impute", """
SELECT page_id,
       COALESCE(NULLIF(regexp_extract(url, '/([a-z]{2})/[0-9]+', 1), ''),
                NULLIF(regexp_extract(html, '<html lang="([A-Za-z-]+)"', 1), '')) AS lang,
       TRY_CAST(NULLIF(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), '') AS BIGINT) AS page_no
FROM pages""")
def regex_impute(spark, sf):
    """Fill a value from text patterns, first the URL, then the markup."""
    pages = read_table(spark, sf, "pages")
    from_url = F.nullif(F.regexp_extract("url", r"/([a-z]{2})/[0-9]+", 1), F.lit(""))
    from_html = F.nullif(F.regexp_extract("html", r'<html lang="([A-Za-z-]+)"', 1), F.lit(""))
    page_no = F.nullif(F.regexp_extract("url", r"/[a-z]{2}/([0-9]+)", 1), F.lit("")).try_cast("bigint")
    return pages.select("page_id", F.coalesce(from_url, from_html).alias("lang"), page_no.alias("page_no"))


# Degrees and the text patterns of ages and degrees.
DEGREES = ["Bachelor's", "Master's", "PhD"]
AGE_PATTERN, DEGREE_PATTERN = r"([0-9]+)-year-old", r"(Bachelor's|Master's|PhD)"

PEOPLE_SQL = f"""pe AS (SELECT c_custkey AS id, 23 + c_custkey % 31 AS a, [{', '.join("'" + d.replace("'", "''") + "'" for d in DEGREES)}][CAST(c_custkey % 3 AS INTEGER) + 1] AS e,
                c_mktsegment AS m FROM customer),
people AS (SELECT id, CASE WHEN id % 7 <> 0 THEN CAST(a AS DOUBLE) END AS age, CASE WHEN id % 5 <> 0 THEN e END AS education,
      CASE id % 4 WHEN 0 THEN 'A ' || a || '-year-old professional in ' || m || ' with a ' || e || ' degree.'
                  WHEN 1 THEN 'Holder of a ' || e || ' degree.' WHEN 2 THEN 'Manager, ' || a || '-year-old, of ' || m || '.' END AS description FROM pe)"""


def _people(spark, sf):
    """A person per customer: age and education are missing here and there, the
    description names both, one of them, or there is none."""
    c = F.col("c_custkey")
    pe = read_table(spark, sf, "customer").select(c.alias("id"), (c % 31 + 23).alias("a"),
                                                  F.element_at(F.array(*[F.lit(d) for d in DEGREES]), (c % 3 + 1).cast("int")).alias("e"), F.col("c_mktsegment").alias("m"))
    text = (F.when(F.col("id") % 4 == 0, F.concat(F.lit("A "), "a", F.lit("-year-old professional in "), "m", F.lit(" with a "), "e", F.lit(" degree.")))
            .when(F.col("id") % 4 == 1, F.concat(F.lit("Holder of a "), "e", F.lit(" degree.")))
            .when(F.col("id") % 4 == 2, F.concat(F.lit("Manager, "), "a", F.lit("-year-old, of "), "m", F.lit("."))))
    return pe.select("id", F.when(F.col("id") % 7 != 0, F.col("a").cast("double")).alias("age"),
                     F.when(F.col("id") % 5 != 0, F.col("e")).alias("education"), text.alias("description"))


@query("text_impute", "WITH " + PEOPLE_SQL + f""",
x AS (SELECT *, TRY_CAST(NULLIF(regexp_extract(description, '{AGE_PATTERN}', 1), '') AS DOUBLE) AS xa,
             NULLIF(regexp_extract(description, '{DEGREE_PATTERN.replace("'", "''")}', 1), '') AS xe FROM people)
SELECT id, COALESCE(age, xa) AS age, COALESCE(education, xe) AS education, age IS NULL AND xa IS NOT NULL AS age_imputed,
       education IS NULL AND xe IS NOT NULL AS education_imputed FROM x""")
def text_impute(spark, sf):
    """Missing ages and degrees filled from the description."""
    return rel.impute_from_text(_people(spark, sf), "description", {"age": AGE_PATTERN, "education": DEGREE_PATTERN}).drop("description")


@query("twin_impute", with_sql(DOCLAB_SQL) + """,
keyed AS (SELECT dl.doc_id, dl.quality, md5(d.text) AS h
          FROM doclab dl JOIN documents d ON d.doc_id = dl.doc_id),
peer AS (SELECT h, MAX(quality) AS peer_quality FROM keyed WHERE quality IS NOT NULL GROUP BY h)
SELECT k.doc_id, COALESCE(k.quality, p.peer_quality) AS quality,
       (k.quality IS NULL AND p.peer_quality IS NOT NULL) AS imputed
FROM keyed k LEFT JOIN peer p ON p.h = k.h""")
def twin_impute(spark, sf):
    """Copy a missing value from a row identical on the other attributes
    (here: the same document text).  Text is reduced to an md5 key before the
    shuffle; the peer side is aggregated (partial agg absorbs hot keys) to one
    row per key, and AQE splits a skewed key on the probe side."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    keyed = doclab(spark, sf).select("doc_id", "quality").join(docs, "doc_id")
    peer = keyed.where(F.col("quality").isNotNull()).groupBy("h").agg(F.max("quality").alias("peer_quality"))
    j = keyed.join(peer, "h", "left")
    return j.select("doc_id", F.coalesce("quality", "peer_quality").alias("quality"),
                    (F.col("quality").isNull() & F.col("peer_quality").isNotNull()).alias("imputed"))


@query("quantile_band", with_sql(FACTS_SQL) + """,
b AS (SELECT QUANTILE_CONT(total, 0.25) AS lo, QUANTILE_CONT(total, 0.75) AS hi FROM facts)
SELECT id, total FROM facts, b WHERE total BETWEEN lo AND hi""")
def quantile_band(spark, sf):
    """Keep rows whose value lies between its own p25 and p75."""
    f = facts(spark, sf)
    band = pf.quantiles_wide(f, "total", [0.25, 0.75], ["__lo", "__hi"])
    return f.crossJoin(F.broadcast(band)).where(F.col("total").between(F.col("__lo"), F.col("__hi"))) \
        .select("id", "total")


# The ordinal lookup applied to the priority codes in C4.
PRIORITY_ORDINAL = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}


@query("lookup_default", with_sql(FACTS_SQL) + """,
ret AS (SELECT l_orderkey AS id, CAST(COUNT(*) AS BIGINT) AS n_returned, 'has_returns' AS return_status
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT f.id,
       CASE f.priority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS priority_num,
       COALESCE(r.n_returned, 0) AS n_returned, COALESCE(r.return_status, 'none') AS return_status
FROM facts f LEFT JOIN ret r ON r.id = f.id""")
def lookup_default(spark, sf):
    """A distinct-key lookup joined left with defaults for misses, plus
    a literal map lookup (miss -> null)."""
    ret = (read_table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
           .groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n_returned"))
           .withColumn("return_status", F.lit("has_returns")))
    f = facts(spark, sf).select("id", literal_map(PRIORITY_ORDINAL, F.col("priority")).alias("priority_num"))
    return rel.lookup_with_defaults(f, ret, "id", {"n_returned": 0, "return_status": "none"})
