"""Step 9: batch category enrichment (2M M1-M13, 2C C2/C3, 2B B13, 2H H13-H15).

The driver's tables hold no job titles and no model replies, so both are derived
from given columns by literal tables: a part's title from its key and size
(every level and area occurs, some parts have none), the replies to title and
description prompts from the rules and from a document's columns, in every
shape a model gives: whole, bare, fenced, short, long, single, broken, missing.
``p_retailprice`` and ``n_chars`` stand in for salary, descriptions are
``documents.text`` (whole texts).
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestar.operators import enrich as en
from lodestar.operators import replies as rep
from lodestar.plans.registry import query
from lodestar.session import scratch_path
from lodestar.sources import tables as io
from lodestar.sources.tables import read_table

BATCH_TITLES = 5         # titles per prompt
BATCH_DESCRIPTIONS = 3   # descriptions per prompt
KINDS = ["object", "list", "fenced", "short", "long", "broken", "none", "single"]      # of the reply to batch 0, 1, ...

# Words of the derived titles.
LEVEL_WORDS = ["Junior", "", "Senior", "Director of", "Lead", "Assistant", "Principal", "VP"]
AREA_WORDS = ["Software", "Sales", "Accounting", "HR", "Operations", "Clinical", "Help Desk", "Product", "Office"]
ROLE_WORDS = ["Analyst", "Manager", "Coordinator", "Specialist", "Engineer", "Clerk"]


def _pick(words, index):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def _sql_pick(words, index):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][CAST({index} % {len(words)} AS INTEGER) + 1]"


def _sql_str(s: str) -> str:
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def _cls_sql(col: str) -> str:
    lvl = en.sql_rule_label(col, en.TITLE_SENIORITY_RULES, None)
    return (f"coalesce({lvl}, '{en.SENIORITY_DEFAULT}') AS seniority_level, "
            f"{en.sql_rule_label(col, en.TITLE_AREA_RULES, en.AREA_DEFAULT)} AS functional_area, "
            f"{en.sql_map(en.SALARY_BY_LEVEL, f'coalesce({lvl}, {chr(39)}{en.SENIORITY_DEFAULT}{chr(39)})')} "
            f"AS salary_expectation, CAST(CASE WHEN {lvl} IS NOT NULL THEN {en.RULE_CONFIDENCE} "
            f"ELSE {en.DEFAULT_CONFIDENCE} END AS DOUBLE) AS confidence")


TITLED_SQL = f"""titled AS (SELECT p_partkey, p_retailprice, CASE WHEN p_size % 25 <> 0 THEN
    concat_ws(' ', NULLIF({_sql_pick(LEVEL_WORDS, 'p_partkey')}, ''), {_sql_pick(AREA_WORDS, 'p_size')}, {_sql_pick(ROLE_WORDS, '(p_partkey // 8)')}) END AS title FROM part)"""
TITLES_SQL = TITLED_SQL + """,
titles AS (SELECT DISTINCT title FROM titled WHERE title IS NOT NULL),
cls AS (SELECT title, """ + _cls_sql("title") + """ FROM titles)"""

MAPPED_SQL = TITLES_SQL + """,
mapped AS (SELECT p.p_partkey, p.title, p.p_retailprice,
                  coalesce(c.seniority_level, 'Unknown') AS llm_seniority,
                  coalesce(c.functional_area, 'Other') AS llm_functional_area,
                  coalesce(c.salary_expectation, 'Medium') AS llm_salary_expectation,
                  coalesce(c.confidence, CAST(0.0 AS DOUBLE)) AS llm_confidence
           FROM titled p LEFT JOIN cls c ON c.title = p.title)"""


def _titled(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    key = F.col("p_partkey")
    words = F.concat_ws(" ", F.nullif(_pick(LEVEL_WORDS, key), F.lit("")), _pick(AREA_WORDS, F.col("p_size")), _pick(ROLE_WORDS, F.floor(key / 8)))
    return part.select("p_partkey", "p_retailprice", F.when(F.col("p_size") % 25 != 0, words).alias("title"))


def _titles(spark, sf):
    return en.distinct_keys(_titled(spark, sf), "title")


def _mapped(spark, sf):
    return en.map_back(_titled(spark, sf).select("p_partkey", "title", "p_retailprice"), "title",
                       en.classify_titles(_titles(spark, sf), "title"))


@query("classify_seniority", "WITH " + TITLES_SQL + """
SELECT title AS job_title, seniority_level, salary_expectation, confidence FROM cls""")
def classify_seniority(spark, sf):
    """M1/M7/M9: seniority and salary expectation of each distinct title."""
    c = en.classify_titles(_titles(spark, sf), "title")
    return c.select(F.col("title").alias("job_title"), "seniority_level", "salary_expectation", "confidence")


@query("classify_area", "WITH " + TITLES_SQL + """
SELECT title AS job_title, functional_area FROM cls""")
def classify_area(spark, sf):
    """M1/M8: functional area of each distinct title."""
    c = en.classify_titles(_titles(spark, sf), "title")
    return c.select(F.col("title").alias("job_title"), "functional_area")


@query("map_back_defaults", "WITH " + MAPPED_SQL + """
SELECT p_partkey, title, llm_seniority, llm_functional_area, llm_salary_expectation, llm_confidence FROM mapped""")
def map_back_defaults(spark, sf):
    """Per-title results joined back onto every part row, defaults on a miss."""
    return _mapped(spark, sf).drop("p_retailprice")


ITEMS_SQL = f"""items AS (SELECT title, CAST((ROW_NUMBER() OVER (ORDER BY title) - 1) // {BATCH_TITLES} AS BIGINT) AS batch_id,
                 CAST((ROW_NUMBER() OVER (ORDER BY title) - 1) % {BATCH_TITLES} AS INTEGER) AS pos FROM titles)"""


@query("prompt_batches", "WITH " + TITLES_SQL + ",\n" + ITEMS_SQL + """
SELECT batch_id, CAST(COUNT(*) AS INTEGER) AS n_items, CAST(to_json(list(title ORDER BY pos)) AS VARCHAR) AS items_json,
       """ + _sql_str(en.PROMPT_HEAD) + """ || CAST(to_json(list(title ORDER BY pos)) AS VARCHAR) AS prompt
FROM items GROUP BY batch_id""")
def prompt_batches(spark, sf):
    """Distinct titles in batches of 5 with the JSON list and prompt text."""
    _, prompts = en.prompt_batches(_titles(spark, sf), "title", BATCH_TITLES)
    return prompts


def answer(prompt: str) -> str:
    """A completion for the check of M3: levels and areas by the length of a
    title; it never answers a prompt whose first title has a length divisible by 7."""
    titles = json.loads(prompt[prompt.index("TITLES:\n") + 8:])
    if len(titles[0]) % 7 == 0:
        raise TimeoutError("no answer")
    return json.dumps({"results": [{"job_title": t, "seniority_level": en.SENIORITY_LEVELS[len(t) % 4], "functional_area": en.FUNCTIONAL_AREAS[len(t) % 9],
                                    "salary_expectation": en.SALARY_EXPECTATIONS[len(t) // 4 % 4], "confidence": len(t) / 64} for t in titles]})


def _fallback_sql(fields: list[str], own: dict[str, str]) -> str:
    """Field expressions for status 'ok' (``own``), fallbacks otherwise, nulls for 'short_reply'."""
    out = []
    for f in fields:
        if f == "confidence":
            other = f"CAST({rep.FALLBACK_CONFIDENCE['no_reply']} AS DOUBLE) WHEN 'parse_error' THEN CAST({rep.FALLBACK_CONFIDENCE['parse_error']} AS DOUBLE)"
        elif f == "validation_notes":
            other = f"'{rep.FALLBACK_NOTES['no_reply']}' WHEN 'parse_error' THEN '{rep.FALLBACK_NOTES['parse_error']}'"
        else:
            other = ("false WHEN 'parse_error' THEN false" if f in rep.FLAGS else f"'{rep.FALLBACK[f]}' WHEN 'parse_error' THEN '{rep.FALLBACK[f]}'")
        out.append(f"CASE status WHEN 'ok' THEN {own[f]} WHEN 'no_reply' THEN {other} END AS {f}")
    return ",\n       ".join(out)


@query("completion_step", "WITH " + TITLES_SQL + ",\n" + ITEMS_SQL + f""",
st AS (SELECT i.*, length(title) AS n, CASE WHEN length(FIRST_VALUE(title) OVER (PARTITION BY batch_id ORDER BY pos)) % 7 = 0
              THEN 'no_reply' ELSE 'ok' END AS status FROM items i)
SELECT batch_id, pos, title, status, """ + _fallback_sql(rep.TITLE_FIELDS, {
    "seniority_level": _sql_pick(en.SENIORITY_LEVELS, "n"), "functional_area": _sql_pick(en.FUNCTIONAL_AREAS, "n"),
    "salary_expectation": _sql_pick(en.SALARY_EXPECTATIONS, "(n // 4)"), "confidence": "n / 64.0"}) + " FROM st")
def completion_step(spark, sf):
    """M3: every prompt is sent to a user function (three tries, then no reply),
    the replies are parsed and aligned."""
    items, prompts = en.prompt_batches(_titles(spark, sf), "title", BATCH_TITLES)
    return rep.align(items.select("batch_id", "pos", "title"), en.model_replies(prompts, answer), rep.TITLE_FIELDS)


def _kind(b: str = "batch_id") -> str:
    return _sql_pick(KINDS, b)


STATUS_SQL = f"""CASE WHEN {_kind()} = 'broken' THEN 'parse_error' WHEN {_kind()} = 'none' THEN 'no_reply'
    WHEN {_kind()} IN ('short', 'single') AND pos > 0 THEN 'short_reply' ELSE 'ok' END"""


def _title_replies(spark, sf):
    """(items, replies): the rules' record of each title, in replies of every kind."""
    titles = _titles(spark, sf)
    items, _ = en.prompt_batches(titles, "title", BATCH_TITLES)
    items = items.select("batch_id", "pos", "title")
    c = items.join(en.classify_titles(titles, "title"), "title")
    record = F.to_json(F.struct(F.col("title").alias("job_title"), *rep.TITLE_FIELDS))
    return items, rep.write_replies(c.select("batch_id", "pos", record.alias("j")), KINDS)


_OWN = {f: f for f in rep.TITLE_FIELDS}


@query("reply_alignment", "WITH " + TITLES_SQL + ",\n" + ITEMS_SQL + f""",
st AS (SELECT i.batch_id, i.pos, cls.*, {STATUS_SQL} AS status FROM items i JOIN cls ON cls.title = i.title)
SELECT batch_id, pos, title, status, """ + _fallback_sql(rep.TITLE_FIELDS, _OWN) + " FROM st")
def reply_alignment(spark, sf):
    """Replies of every kind parsed and aligned to the items of their
    batch by position; what a reply lacks is unanswered, what it has too much is dropped."""
    items, replies = _title_replies(spark, sf)
    return rep.align(items, replies, rep.TITLE_FIELDS)


@query("reply_fallback", "WITH " + TITLES_SQL + ",\n" + ITEMS_SQL + f""",
st AS (SELECT i.batch_id, i.pos, cls.*, {STATUS_SQL} AS status, COUNT(*) OVER (PARTITION BY batch_id) AS k FROM items i JOIN cls ON cls.title = i.title),
al AS (SELECT * FROM st WHERE status = 'ok' OR (status <> 'short_reply' AND pos = 0)
       UNION ALL SELECT * REPLACE (CAST(pos + k AS INTEGER) AS pos) FROM st WHERE {_kind()} = 'long')
SELECT batch_id, pos, status, """ + _fallback_sql(rep.TITLE_FIELDS, _OWN) + " FROM al")
def reply_fallback(spark, sf):
    """Every record of every reply; a missing reply gives the fallback
    with confidence 0.0, one that is not JSON the one with 0.5."""
    return rep.all_records(_title_replies(spark, sf)[1], rep.TITLE_FIELDS, ["batch_id"])


# ---- descriptions ------------------------------------------------------------

N, D = "n_chars", "doc_id"
_TEXT_RULES = {      # field: (domain, index expression)
    "seniority_level": (en.SENIORITY_LEVELS, "n_chars"), "functional_area": (en.FUNCTIONAL_AREAS, "doc_id"),
    "salary_expectation": (en.SALARY_EXPECTATIONS, "(n_chars // 4)"), "management_level": (en.MANAGEMENT_LEVELS, "doc_id"),
    "responsibility_level": (en.RESPONSIBILITY_LEVELS, "(n_chars // 16)")}
_FLAG_RULES = {"has_leadership": ("n_chars", 2), "has_strategic_role": ("n_chars", 3), "has_budget_responsibility": ("n_chars", 5),
               "has_client_facing": ("doc_id", 2), "requires_technical_skills": ("doc_id", 3)}


def _record(docs):
    """JSON record of a document from its columns: some fields are left out, of
    another type than asked for, or in words."""
    n, d = F.col(N), F.col(D)
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    index = {"n_chars": n, "doc_id": d, "(n_chars // 4)": F.floor(n / 4), "(n_chars // 16)": F.floor(n / 16)}
    fields = {f: text(_pick(domain, index[i])) for f, (domain, i) in _TEXT_RULES.items()}
    years = (n % 31).cast("string")
    fields["years_experience"] = F.when(n % 5 == 0, text(F.concat(F.lit("about "), years, F.lit(" years")))).when(n % 7 != 0, years)
    for f, (c, k) in _FLAG_RULES.items():
        fields[f] = (index[c] % k == 0).cast("string")
    fields["has_strategic_role"] = F.when(n % 11 == 0, F.lit('"maybe"')).otherwise(fields["has_strategic_role"])
    fields["education_level"] = F.when(n % 13 != 0, text(_pick(en.EDUCATION_LEVELS, d)))
    skills = F.concat(F.lit("["), text(_pick(en.SKILL_VOCABULARY, d)), F.lit(", "), text(_pick(en.SKILL_VOCABULARY, d + 3)), F.lit("]"))
    fields["key_skills"] = F.when(d % 6 == 0, F.lit("[]")).when(d % 10 == 7, F.lit('"python"')).otherwise(skills)
    fields["validation_notes"] = text(F.concat(F.lit("from "), F.coalesce("lang", F.lit("?"))))
    fields["confidence"] = F.when(n % 17 == 0, F.lit('"high"')).otherwise(F.concat(F.lit("0."), F.lpad((n % 100).cast("string"), 2, "0")))
    return rep.json_object(fields)


_DOC_OWN = {f: _sql_pick(domain, i) for f, (domain, i) in _TEXT_RULES.items()} | {
    f: f"({c} % {k} = 0)" for f, (c, k) in _FLAG_RULES.items()} | {
    "has_strategic_role": "(n_chars % 3 = 0 AND n_chars % 11 <> 0)",
    "years_experience": "CASE WHEN n_chars % 5 = 0 OR n_chars % 7 <> 0 THEN CAST(n_chars % 31 AS VARCHAR) ELSE 'Unknown' END",
    "education_level": f"CASE WHEN n_chars % 13 <> 0 THEN {_sql_pick(en.EDUCATION_LEVELS, 'doc_id')} ELSE 'Other' END",
    "key_skills": f"CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 10 = 7 THEN 'python' ELSE {_sql_pick(en.SKILL_VOCABULARY, 'doc_id')} || ', ' || "
                  f"{_sql_pick(en.SKILL_VOCABULARY, '(doc_id + 3)')} END",
    "validation_notes": "'from ' || coalesce(lang, '?')",
    "confidence": "CASE WHEN n_chars % 17 = 0 THEN CAST(0.0 AS DOUBLE) ELSE (n_chars % 100) / 100.0 END"}
DOC_ITEMS_SQL = f"""it AS (SELECT doc_id, n_chars, lang, CAST((ROW_NUMBER() OVER (ORDER BY doc_id) - 1) // {BATCH_DESCRIPTIONS} AS BIGINT) AS batch_id,
              CAST((ROW_NUMBER() OVER (ORDER BY doc_id) - 1) % {BATCH_DESCRIPTIONS} AS INTEGER) AS pos FROM documents),
st AS (SELECT *, {STATUS_SQL} AS status FROM it),
answered AS (SELECT doc_id, batch_id, pos, n_chars, status, {_fallback_sql(rep.DESCRIPTION_FIELDS, _DOC_OWN)} FROM st)"""


def _answered(spark, sf):
    """Documents in batches of 3 with the record of the reply at their position."""
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    items = en.batch_number(docs, ["doc_id"], BATCH_DESCRIPTIONS)
    replies = rep.write_replies(items.select("batch_id", "pos", _record(items).alias("j")), KINDS)
    return rep.align(items.select("doc_id", "batch_id", "pos", "n_chars"), replies, rep.DESCRIPTION_FIELDS)


def _llm(c: str) -> str:
    return "llm_seniority" if c == "seniority_level" else f"llm_{c}"


@query("description_replies", "WITH " + DOC_ITEMS_SQL + "\nSELECT doc_id, batch_id, pos, status, " + ", ".join(rep.DESCRIPTION_FIELDS) + " FROM answered")
def description_replies(spark, sf):
    """The 15 fields of every description's reply, each read
    by itself with its default; skills joined, years a number or 'Unknown'."""
    return _answered(spark, sf).drop("n_chars")


@query("fill_llm_defaults", "WITH " + DOC_ITEMS_SQL + "\nSELECT doc_id, " + ", ".join(
    f"COALESCE({f}, {'false' if f in rep.FLAGS else 'CAST(0.0 AS DOUBLE)' if f == 'confidence' else chr(39) + 'Unknown' + chr(39)}) AS {_llm(f)}"
    for f in rep.DESCRIPTION_FIELDS) + " FROM answered")
def fill_llm_defaults(spark, sf):
    """Items a reply left unanswered are filled by column class: flags
    False, confidence 0.0, any other column 'Unknown'."""
    filled = rep.fill_unanswered(_answered(spark, sf), rep.DESCRIPTION_FIELDS)
    return filled.select("doc_id", *[F.col(f).alias(_llm(f)) for f in rep.DESCRIPTION_FIELDS])


@query("description_prompts", f"""
WITH it AS (SELECT doc_id, COALESCE(CASE WHEN doc_id % 10 <> 0 THEN text END, '{en.NO_DESCRIPTION}') AS item,
                   CAST((ROW_NUMBER() OVER (ORDER BY doc_id) - 1) // 3 AS BIGINT) AS batch_id,
                   CAST((ROW_NUMBER() OVER (ORDER BY doc_id) - 1) % 3 AS INTEGER) AS pos FROM documents),
p AS (SELECT batch_id, CAST(COUNT(*) AS INTEGER) AS n_items, CAST(to_json(list(doc_id ORDER BY pos)) AS VARCHAR) AS doc_ids,
             CAST(SUM(length(item)) AS BIGINT) AS n_chars,
             {_sql_str(en.DESCRIPTION_HEAD)} || CAST(to_json(list(item ORDER BY pos)) AS VARCHAR) AS prompt FROM it GROUP BY batch_id)
SELECT batch_id, n_items, doc_ids, n_chars, CAST(length(prompt) AS INTEGER) AS prompt_chars, sha256(prompt) AS prompt_sha256 FROM p""")
def description_prompts(spark, sf):
    """Descriptions in batches of 3 (a tenth of them missing: sent as the
    default text), one prompt per batch with the whole texts, given here by
    its length and digest."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("text"))
    _, prompts = en.description_batches(docs, "doc_id", "text", 3)
    return prompts.select("batch_id", "n_items", "doc_ids", "n_chars", F.length("prompt").alias("prompt_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


# ---- reports -------------------------------------------------------------------

def _report_sql(src: str, dims: list[str], measures: dict[str, tuple[str, str]], cross: tuple[str, str] | None) -> str:
    aggs = ", ".join(f"AVG({c}) AS {m}" if kind == "mean" else f"CAST(COUNT(*) FILTER ({c}) AS BIGINT) AS {m}" for m, (kind, c) in measures.items())
    none = "CAST(NULL AS VARCHAR)"
    sets = [(f"'{d}'", d, none, f"GROUP BY {d}") for d in dims] + [("'total'", none, none, "")]
    if cross:
        sets.append((f"'{cross[0]} x {cross[1]}'", *cross, f"GROUP BY {cross[0]}, {cross[1]}"))
    rows = " UNION ALL ".join(f"SELECT {d} AS dimension, {a} AS label, {b} AS other, COUNT(*) AS n, {aggs} FROM {src} {g}" for d, a, b, g in sets)
    out = ", ".join(f"ROUND({m}, 4) AS {m}" if kind == "mean" else m for m, (kind, _) in measures.items())
    return f"""report AS (SELECT dimension, label, other, n, ROUND(n * 100.0 / (SELECT COUNT(*) FROM {src}), 4) AS pct, {out} FROM ({rows}))"""


TITLE_DIMS = ["llm_seniority", "llm_functional_area", "llm_salary_expectation"]
TITLE_MEASURES = {"mean_price": ("mean", "p_retailprice"), "mean_confidence": ("mean", "llm_confidence")}
TITLE_CROSS = ("llm_seniority", "llm_functional_area")


@query("enrich_report", "WITH " + MAPPED_SQL + ",\n" + _report_sql("mapped", TITLE_DIMS, TITLE_MEASURES, TITLE_CROSS) + "\nSELECT * FROM report")
def enrich_report(spark, sf):
    """Distribution of each enriched dimension with share, mean price (the
    salary stand-in) and mean confidence, a crosstab and the whole, from one
    aggregation over grouping sets."""
    return en.enrichment_report(_mapped(spark, sf), TITLE_DIMS, TITLE_MEASURES, TITLE_CROSS)


DOC_DIMS = ["seniority_level", "functional_area", "management_level", "responsibility_level"]
DOC_MEASURES = {**{f"n_{f}": ("count", f) for f in rep.FLAGS}, "mean_n_chars": ("mean", "n_chars"), "mean_confidence": ("mean", "confidence")}
DOC_CROSS = ("seniority_level", "management_level")


@query("description_report", "WITH " + DOC_ITEMS_SQL + """,
filled AS (SELECT n_chars, """ + ", ".join(
    f"COALESCE({f}, {'false' if f in rep.FLAGS else 'CAST(0.0 AS DOUBLE)' if f == 'confidence' else chr(39) + 'Unknown' + chr(39)}) AS {f}"
    for f in [*DOC_DIMS, *rep.FLAGS, "confidence"]) + " FROM answered),\n" + _report_sql("filled", DOC_DIMS, DOC_MEASURES, DOC_CROSS) + """
SELECT 'csv' AS sink, * FROM report UNION ALL SELECT 'table', * FROM report""")
def description_report(spark, sf):
    """Level, area and management distributions with the five flag
    totals, mean length (the salary stand-in) and mean confidence; written as CSV
    and as a table, and read back from both."""
    filled = rep.fill_unanswered(_answered(spark, sf), rep.DESCRIPTION_FIELDS)
    report = io.create_table_as(spark, "lodestar_description_report", en.enrichment_report(filled, DOC_DIMS, DOC_MEASURES, DOC_CROSS))
    path = io.write_csv(report, scratch_path(spark, "description-report"))
    back = spark.read.option("header", True).schema(report.schema).csv(path)
    return back.select(F.lit("csv").alias("sink"), "*").unionByName(report.select(F.lit("table").alias("sink"), "*"))


def _dom(vals):
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


@query("domain_violations", "WITH " + MAPPED_SQL + f"""
SELECT 'seniority_level' AS dimension, {len(en.SENIORITY_LEVELS)} AS domain_size, COUNT(llm_seniority) AS n_values,
       COUNT(*) FILTER (WHERE llm_seniority NOT IN {_dom(en.SENIORITY_LEVELS)}) AS n_violations FROM mapped
UNION ALL
SELECT 'functional_area', {len(en.FUNCTIONAL_AREAS)}, COUNT(llm_functional_area),
       COUNT(*) FILTER (WHERE llm_functional_area NOT IN {_dom(en.FUNCTIONAL_AREAS)}) FROM mapped
UNION ALL
SELECT 'salary_expectation', {len(en.SALARY_EXPECTATIONS)}, COUNT(llm_salary_expectation),
       COUNT(*) FILTER (WHERE llm_salary_expectation NOT IN {_dom(en.SALARY_EXPECTATIONS)}) FROM mapped""")
def domain_violations(spark, sf):
    """Enriched values outside the 4 / 9 / 4 demanded categories (a part
    without a title is 'Unknown')."""
    m = _mapped(spark, sf).select(F.col("llm_seniority").alias("seniority_level"),
                                  F.col("llm_functional_area").alias("functional_area"),
                                  F.col("llm_salary_expectation").alias("salary_expectation"))
    return en.domain_violations(m)


@query("description_attributes", "SELECT " + en.sql_describe_text("doc_id", "text") + "\nFROM documents")
def description_attributes(spark, sf):
    """The description attributes of every document, whole texts."""
    return en.describe_text(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
