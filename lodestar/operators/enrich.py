"""Batch category enrichment (survey 2M), re-aimed as a distributed job.

The reference classifies job titles and descriptions with a language model:
distinct keys -> batches -> one prompt per batch -> JSON reply -> parse ->
map back with defaults.  Here every stage is a DataFrame step:

* distinct keys first (M1): the expensive step sees each key once; Catalyst
  cannot deduplicate in front of an opaque function by itself;
* batches (M2/E3) come from an exact global position, prompts are built with
  ``collect_list`` + ``to_json`` per batch (a batch holds ``size`` items, so
  no group is unbounded);
* the completion step (M3) is pluggable: a user function ``prompt -> reply``
  runs in ``mapInPandas`` (Arrow batches, retries, ``None`` on failure); the
  default completion is the rule classifier below, evaluated as Catalyst
  expressions and serialised as the same JSON reply;
* replies are parsed and aligned by position in :mod:`lodestar.operators.replies`
  (M4, M5, C3), results are mapped back by key (M6).

The rules are a declared substitute for the model: same output schema and
domains, not the same labels.  They are a ``CASE`` chain (first match wins),
so they run inside whole-stage codegen and have an exact SQL twin.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.ordering import batch_number
from lodestar.operators.relational import small_side

# ---------------------------------------------------------------------------
# Output domains and keyword rules.  Category names and keyword
# lists follow the reference's prompt text; the priority order encodes its
# explicit overrides (junior -> Entry Level, directors are executives, project
# managers are Senior Level, anything with HR / product is HR / Product).
SENIORITY_LEVELS = ["Entry Level", "Mid Level", "Senior Level", "Executive"]
FUNCTIONAL_AREAS = ["Technology", "Sales_Marketing", "Finance", "HR", "Operations", "Research",
                    "Customer_Service", "Product", "Other"]
SALARY_EXPECTATIONS = ["Low", "Medium", "High", "Very_High"]
MANAGEMENT_LEVELS = ["None", "Team_Lead", "Manager", "Director"]
RESPONSIBILITY_LEVELS = ["Low", "Medium", "High", "Very_High"]
EDUCATION_LEVELS = ["High_School", "Bachelor", "Master", "PhD", "Other"]

# Rules of the description prompt.
SENIORITY_RULES = [
    ("Entry Level", ["junior", "assistant", "intern", "trainee", "copywriter", "recent graduate"]),
    ("Executive", ["director", "vp", "ceo", "cto", "executive", "head of department"]),
    ("Senior Level", ["project manager"]),
    ("Senior Level", ["senior", "lead", "principal", "extensive experience", "many years"]),
    ("Executive", ["manager"]),
    ("Mid Level", ["specialist", "analyst", "coordinator"]),
]
SENIORITY_DEFAULT = "Mid Level"

AREA_RULES = [
    ("HR", ["hr", "human resources", "recruiter", "talent", "training", "people management"]),
    ("Product", ["product"]),
    ("Technology", ["software", "developer", "engineer", "IT", "data scientist", "programmer", "technical"]),
    ("Sales_Marketing", ["sales", "marketing", "account", "business development", "social media", "brand"]),
    ("Finance", ["financial", "accounting", "audit", "treasury", "investment", "budgeting"]),
    ("Operations", ["operations", "project manager", "supply chain", "logistics", "process improvement"]),
    ("Research", ["scientist", "researcher", "r&d", "clinical", "studies"]),
    ("Customer_Service", ["customer service", "support", "help desk", "client relations"]),
]
# Rules of the title prompt: it names fewer words.
TITLE_SENIORITY_RULES = [
    ("Entry Level", ["junior", "assistant", "intern", "trainee", "copywriter"]),
    ("Executive", ["director", "vp", "ceo", "cto"]),
    ("Senior Level", ["project manager"]),
    ("Senior Level", ["senior", "lead", "principal"]),
    ("Executive", ["manager"]),
    ("Mid Level", ["specialist", "analyst", "coordinator"]),
]
TITLE_AREA_RULES = [
    ("HR", ["hr", "human resources", "recruiter", "talent", "training"]),
    ("Product", ["product"]),
    ("Technology", ["software", "developer", "engineer", "IT", "data scientist", "programmer"]),
    ("Sales_Marketing", ["sales", "marketing", "account", "business development", "social media", "brand"]),
    ("Finance", ["financial", "accounting", "audit", "treasury", "investment"]),
    ("Operations", ["operations", "project manager", "supply chain", "logistics"]),
    ("Research", ["scientist", "researcher", "r&d", "clinical"]),
    ("Customer_Service", ["customer service", "support", "help desk"]),
]
AREA_DEFAULT = "Other"

# Our choice (the reference gives no keyword rule for it): salary expectation
# follows the seniority level.
SALARY_BY_LEVEL = {"Entry Level": "Low", "Mid Level": "Medium", "Senior Level": "High", "Executive": "Very_High"}

MANAGEMENT_RULES = [
    ("Director", ["director", "vp", "head of"]),
    ("Manager", ["manager", "management"]),
    ("Team_Lead", ["team lead", "lead"]),
]
RESPONSIBILITY_BY_MANAGEMENT = {"Director": "Very_High", "Manager": "High", "Team_Lead": "Medium", "None": "Low"}
EDUCATION_RULES = [
    ("PhD", ["phd", "doctorate"]),
    ("Master", ["master", "masters", "mba"]),
    ("Bachelor", ["bachelor", "bachelors", "degree"]),
    ("High_School", ["high school"]),
]
FLAG_RULES = {
    "has_leadership": ["lead", "leadership", "manage", "managing", "mentor"],
    "has_strategic_role": ["strategy", "strategic"],
    "has_budget_responsibility": ["budget", "budgeting"],
    "has_client_facing": ["client", "clients", "customer", "customers"],
    "requires_technical_skills": ["software", "technical", "engineering", "programming", "data"],
}
SKILL_VOCABULARY = ["python", "sql", "excel", "java", "communication", "leadership", "sales", "marketing",
                    "design", "analysis"]
# Years ranges a seniority level allows (M11): Entry 0-2, Mid 3-7, Senior 8-15, Executive 15+.
LEVEL_YEARS = [("Entry Level", 0, 2), ("Mid Level", 3, 7), ("Senior Level", 8, 15), ("Executive", 15, None)]
# Defaults for keys the enrichment did not return.
MISS_DEFAULTS = {"llm_seniority": "Unknown", "llm_functional_area": "Other", "llm_salary_expectation": "Medium",
                 "llm_confidence": 0.0}
RULE_CONFIDENCE, DEFAULT_CONFIDENCE = 0.9, 0.6
# Null inputs are sent as these texts.
NO_TITLE, NO_DESCRIPTION = "Unknown", "No description available"
# ---------------------------------------------------------------------------


def _alternation(words: list[str]) -> str:
    """Keywords in capitals match as written ("IT" is not the pronoun)."""
    return "|".join(f"(?-i:{w})" if w.isupper() else w.replace("&", "[&]") for w in words)


def keyword_pattern(words: list[str]) -> str:
    """Case-insensitive whole-word alternation.  The word edges are explicit
    character classes (not ``\\b``), so Java regex and RE2 agree on accented
    letters."""
    alt = _alternation(words)
    return f"(?i)(^|[^a-z0-9])({alt})([^a-z0-9]|$)"


def rule_label(text: Column, rules, default: str | None) -> Column:
    """First matching rule wins; no match gives ``default``."""
    expr = F.lit(default)
    for label, words in reversed(rules):
        expr = F.when(text.rlike(keyword_pattern(words)), F.lit(label)).otherwise(expr)
    return expr


def sql_rule_label(text_sql: str, rules, default: str | None) -> str:
    whens = " ".join(f"WHEN regexp_matches({text_sql}, '{keyword_pattern(w)}') THEN '{label}'" for label, w in rules)
    dflt = "NULL" if default is None else f"'{default}'"
    return f"(CASE {whens} ELSE {dflt} END)"


def _map_expr(mapping: dict, key: Column) -> Column:
    expr = F.lit(None).cast("string")
    for k, v in mapping.items():
        expr = F.when(key == F.lit(k), F.lit(v)).otherwise(expr)
    return expr


def sql_map(mapping: dict, key_sql: str) -> str:
    return "(CASE " + " ".join(f"WHEN {key_sql} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END)"


def classify_titles(titles: DataFrame, col: str) -> DataFrame:
    """M7-M9 on a frame of distinct titles: seniority, area, salary, confidence."""
    t = F.col(col)
    level = rule_label(t, TITLE_SENIORITY_RULES, None)
    area = rule_label(t, TITLE_AREA_RULES, AREA_DEFAULT)
    out = titles.select(col, level.alias("__lvl"), area.alias("functional_area"))
    lvl = F.coalesce(F.col("__lvl"), F.lit(SENIORITY_DEFAULT))
    return out.select(col, lvl.alias("seniority_level"), "functional_area",
                      _map_expr(SALARY_BY_LEVEL, lvl).alias("salary_expectation"),
                      F.when(F.col("__lvl").isNotNull(), F.lit(RULE_CONFIDENCE))
                      .otherwise(F.lit(DEFAULT_CONFIDENCE)).alias("confidence"))


def distinct_keys(df: DataFrame, col: str) -> DataFrame:
    """The non-null distinct keys (partial distinct before the shuffle)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


# ---- batches and prompts (M2) ---------------------------------------------

PROMPT_HEAD = ("Classify each job title below into a seniority level (Entry Level, Mid Level, Senior Level, "
               "Executive), a functional area and a salary expectation (Low, Medium, High, Very_High). "
               "Answer with JSON only, as {\"results\": [...]}.\nTITLES:\n")


def prompt_batches(keys: DataFrame, col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(items, prompts).  ``items`` = (batch_id, pos, key); ``prompts``
    = one row per batch with the JSON list of its keys and the prompt text."""
    items = batch_number(keys, [col], size)
    per = items.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", col))).alias("__it"))
    names = F.transform("__it", lambda s: s[col])
    prompts = per.select("batch_id", F.size("__it").alias("n_items"), F.to_json(names).alias("items_json"))
    prompts = prompts.withColumn("prompt", F.concat(F.lit(PROMPT_HEAD), F.col("items_json")))
    return items, prompts


DESCRIPTION_HEAD = ("Analyse each job description below: seniority, functional area, salary expectation, "
                    "management and responsibility level, years of experience, five yes/no flags, education, "
                    "key skills, notes and a confidence.  Answer with JSON only, as {\"results\": [...]}.\n"
                    "DESCRIPTIONS:\n")


def description_batches(docs: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """H15/M2 for descriptions: batches of ``size`` in key order, null text
    sent as the default text, one prompt per batch with the whole texts.
    The exact position is computed on the keys alone (the checkpoint inside
    ``batch_number`` then holds keys, not texts); texts join back by key."""
    idx = batch_number(docs.select(key), [key], size)
    items = idx.join(docs.select(key, F.coalesce(F.col(text), F.lit(NO_DESCRIPTION)).alias("item")), key)
    per = items.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", key, "item"))).alias("__it"),
                                        F.sum(F.length("item")).alias("n_chars"))
    prompts = per.select("batch_id", F.size("__it").alias("n_items"),
                         F.to_json(F.transform("__it", lambda s: s[key])).alias("doc_ids"), "n_chars",
                         F.concat(F.lit(DESCRIPTION_HEAD), F.to_json(F.transform("__it", lambda s: s["item"])))
                         .alias("prompt"))
    return items, prompts


# ---- completion (M3) --------------------------------------------------------

def rule_replies(items: DataFrame, col: str) -> DataFrame:
    """Default completion: the rule classifier, serialised as the JSON reply a
    model would give, one reply per batch (batch_id, reply)."""
    c = classify_titles(items.select("batch_id", "pos", col), col)
    c = items.select("batch_id", "pos", col).join(c, col)
    rec = F.struct(F.col("pos"), F.struct(F.col(col).alias("job_title"), "seniority_level", "functional_area",
                                          "salary_expectation", "confidence").alias("r"))
    per = c.groupBy("batch_id").agg(F.sort_array(F.collect_list(rec)).alias("__r"))
    return per.select("batch_id", F.to_json(F.struct(F.transform("__r", lambda s: s["r"]).alias("results")))
                      .alias("reply"))


def model_replies(prompts: DataFrame, complete: Callable[[str], str | None], tries: int = 3) -> DataFrame:
    """M3 with a user completion function (prompt -> reply text).  Runs in
    ``mapInPandas``; each prompt is tried up to ``tries`` times, a prompt that
    never succeeds gets a null reply (-> fallback record downstream)."""
    def run(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                reply = None
                for _ in range(tries):
                    try:
                        reply = complete(p)
                        break
                    except Exception:  # noqa: BLE001 -- a failed call is retried, then null
                        reply = None
                out.append(reply)
            yield pd.DataFrame({"batch_id": pdf["batch_id"], "reply": out})
    return prompts.select("batch_id", "prompt").mapInPandas(run, "batch_id bigint, reply string")


# ---- map back (M6) -------------------------------------------------------

def map_back(df: DataFrame, col: str, classified: DataFrame) -> DataFrame:
    """Left join the per-key result onto every row; a miss gets the
    defaults.  The classified side has one row per distinct key and is broadcast
    if it is small, so a key that most rows have meets no single task."""
    c = small_side(classified.select(col, F.col("seniority_level").alias("__s"), F.col("functional_area").alias("__a"),
                          F.col("salary_expectation").alias("__x"), F.col("confidence").alias("__c")))
    j = df.join(c, col, "left")
    d = MISS_DEFAULTS
    return j.select(*df.columns,
                    F.coalesce("__s", F.lit(d["llm_seniority"])).alias("llm_seniority"),
                    F.coalesce("__a", F.lit(d["llm_functional_area"])).alias("llm_functional_area"),
                    F.coalesce("__x", F.lit(d["llm_salary_expectation"])).alias("llm_salary_expectation"),
                    F.coalesce("__c", F.lit(d["llm_confidence"])).alias("llm_confidence"))


# ---- description attributes (M10, M11) -------------------------------------

YEARS_PATTERN = r"(?i)(?:^|[^0-9])([0-9]{1,2})\+? ?-?years?"


def level_from_years(years: Column) -> Column:
    expr = F.lit(None).cast("string")
    for label, lo, hi in reversed(LEVEL_YEARS):
        cond = years >= lo if hi is None else (years >= lo) & (years <= hi)
        expr = F.when(cond, F.lit(label)).otherwise(expr)
    return expr


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in SENIORITY_LEVELS]), level)


def keyword_hits(text: Column, tokens: Column, words: list[str]) -> Column:
    """The keywords (lower-cased) that occur in a text as whole words, from its
    distinct tokens (runs of ASCII letters and digits, as written): a
    one-token keyword is a token, a longer one is looked for in the text only
    if its first token is there.  Same semantics as :func:`keyword_pattern`."""
    single = sorted({w for w in words if re.fullmatch("[a-z0-9]+", w)})
    phrases = sorted({w for w in words if not re.fullmatch("[A-Za-z0-9]+", w)})
    exact = sorted({w for w in words if w.isupper() and w.isalnum()})
    firsts = {re.match("[a-z0-9]+", w)[0] for w in phrases}
    known = F.array(*[F.lit(w) for w in sorted({*single, *firsts})])
    seen = F.array_intersect(F.transform(tokens, lambda t: F.lower(t)), known)
    keep = F.array(*[F.lit(w) for w in single])

    def with_phrases(hit: Column) -> Column:
        more = [F.when(F.array_contains(hit, re.match("[a-z0-9]+", w)[0]) & text.rlike(keyword_pattern([w])), F.lit(w)) for w in phrases]
        more += [F.when(F.array_contains(tokens, w), F.lit(w.lower())) for w in exact]
        return F.concat(F.array_intersect(hit, keep), F.array_compact(F.array(*more)))
    return F.get(F.transform(F.array(seen), with_phrases), F.lit(0))             # evaluated once


def _has_any(hits: Column, words: list[str]) -> Column:
    return F.arrays_overlap(hits, F.array(*[F.lit(w.lower()) for w in words]))


def label_from_hits(hits: Column, rules, default: str | None) -> Column:
    """First rule with a keyword among ``hits`` wins (same order as rule_label)."""
    expr = F.lit(default)
    for label, words in reversed(rules):
        expr = F.when(_has_any(hits, words), F.lit(label)).otherwise(expr)
    return expr


def _words(rules) -> list[str]:
    return [w for _, ws in rules for w in ws]


def describe_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """The 15 description attributes from whole texts, with the
    conservative validation: Executive needs explicit evidence, and stated
    years that a level does not allow lower it, never raise it.

    Long texts dominate the cost, so each is cut into distinct tokens once; the
    keywords of all families are found among these, and every label is an
    array test on the few that occur."""
    t = F.coalesce(F.col(text), F.lit(""))
    flag_words = [w for ws in FLAG_RULES.values() for w in ws]
    words = [*_words(SENIORITY_RULES), *flag_words, *_words(EDUCATION_RULES), *SKILL_VOCABULARY, *_words(AREA_RULES), *_words(MANAGEMENT_RULES)]
    staged = df.select(F.col(key), t.alias("__t"), F.array_distinct(F.split(t, "[^A-Za-z0-9]+")).alias("__tokens"))
    years = F.when(F.lower("__t").contains("year"), F.regexp_extract("__t", YEARS_PATTERN, 1))
    staged = staged.select(F.col(key), keyword_hits(F.col("__t"), F.col("__tokens"), words).alias("__h"),
                           F.nullif(years, F.lit("")).try_cast("int").alias("__yrs"))
    staged = staged.select(key, *[F.col("__h").alias(c) for c in ("__hs", "__hf", "__he", "__hk", "__ha", "__hm")], "__yrs")
    hs, yrs = F.col("__hs"), F.col("__yrs")
    raw_level = label_from_hits(hs, SENIORITY_RULES, SENIORITY_DEFAULT)
    exec_evidence = _has_any(hs, ["director", "vp", "ceo", "cto", "executive", "head of department"])
    lvl0 = F.when((raw_level == "Executive") & ~exec_evidence, F.lit("Senior Level")).otherwise(raw_level)
    by_years = level_from_years(yrs)
    changed = by_years.isNotNull() & (level_rank(by_years) < level_rank(lvl0))
    level = F.when(changed, by_years).otherwise(lvl0)
    mgmt = label_from_hits(F.col("__hm"), MANAGEMENT_RULES, "None")
    notes = F.when(changed, F.lit("level set from stated years")) \
        .when((raw_level == "Executive") & ~exec_evidence, F.lit("executive without evidence: downgraded")) \
        .otherwise(F.lit("keyword rules"))
    skills = F.array_compact(F.array(*[F.when(F.array_contains("__hk", s), F.lit(s)) for s in SKILL_VOCABULARY]))
    cols = [F.col(key),
            level.alias("llm_seniority"),
            label_from_hits(F.col("__ha"), AREA_RULES, AREA_DEFAULT).alias("llm_functional_area"),
            _map_expr(SALARY_BY_LEVEL, level).alias("llm_salary_expectation"),
            mgmt.alias("llm_management_level"),
            _map_expr(RESPONSIBILITY_BY_MANAGEMENT, mgmt).alias("llm_responsibility_level"),
            F.coalesce(yrs.cast("string"), F.lit("Unknown")).alias("llm_years_experience"),
            yrs.cast("double").alias("llm_years_experience_num")]
    cols += [_has_any(F.col("__hf"), w).alias(f"llm_{f}") for f, w in FLAG_RULES.items()]
    cols += [label_from_hits(F.col("__he"), EDUCATION_RULES, "Other").alias("llm_education_level"),
             F.array_join(skills, ", ").alias("llm_key_skills"),
             notes.alias("llm_validation_notes"),
             F.when(raw_level != SENIORITY_DEFAULT, F.lit(RULE_CONFIDENCE)).otherwise(F.lit(DEFAULT_CONFIDENCE))
             .alias("llm_confidence")]
    return staged.select(*cols)


def sql_describe_text(key: str, text: str) -> str:
    """DuckDB twin of :func:`describe_text` (a SELECT list)."""
    t = f"coalesce({text}, '')"
    raw = sql_rule_label(t, SENIORITY_RULES, SENIORITY_DEFAULT)
    ev = f"regexp_matches({t}, '{keyword_pattern(['director', 'vp', 'ceo', 'cto', 'executive', 'head of department'])}')"
    yrs = f"TRY_CAST(NULLIF(regexp_extract({t}, '{YEARS_PATTERN}', 1), '') AS INTEGER)"
    by_years = "(CASE " + " ".join(
        f"WHEN {yrs} >= {lo}" + ("" if hi is None else f" AND {yrs} <= {hi}") + f" THEN '{label}'"
        for label, lo, hi in LEVEL_YEARS) + " END)"
    lvl0 = f"(CASE WHEN {raw} = 'Executive' AND NOT {ev} THEN 'Senior Level' ELSE {raw} END)"
    ranks = {label: i for i, label in enumerate(SENIORITY_LEVELS)}
    changed = f"({by_years} IS NOT NULL AND CAST({sql_map(ranks, by_years)} AS INTEGER) < CAST({sql_map(ranks, lvl0)} AS INTEGER))"
    level = f"(CASE WHEN {changed} THEN {by_years} ELSE {lvl0} END)"
    mgmt = sql_rule_label(t, MANAGEMENT_RULES, "None")
    notes = (f"(CASE WHEN {changed} THEN 'level set from stated years' WHEN {raw} = 'Executive' AND NOT {ev} "
             f"THEN 'executive without evidence: downgraded' ELSE 'keyword rules' END)")
    skills = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN regexp_matches({t}, '{keyword_pattern([w])}') THEN '{w}' END" for w in SKILL_VOCABULARY) + ")"
    cols = [key, f"{level} AS llm_seniority", f"{sql_rule_label(t, AREA_RULES, AREA_DEFAULT)} AS llm_functional_area",
            f"{sql_map(SALARY_BY_LEVEL, level)} AS llm_salary_expectation", f"{mgmt} AS llm_management_level",
            f"{sql_map(RESPONSIBILITY_BY_MANAGEMENT, mgmt)} AS llm_responsibility_level",
            f"coalesce(CAST({yrs} AS VARCHAR), 'Unknown') AS llm_years_experience",
            f"CAST({yrs} AS DOUBLE) AS llm_years_experience_num"]
    cols += [f"regexp_matches({t}, '{keyword_pattern(w)}') AS llm_{f}" for f, w in FLAG_RULES.items()]
    cols += [f"{sql_rule_label(t, EDUCATION_RULES, 'Other')} AS llm_education_level",
             f"{skills} AS llm_key_skills", f"{notes} AS llm_validation_notes",
             f"CAST(CASE WHEN {raw} <> '{SENIORITY_DEFAULT}' THEN {RULE_CONFIDENCE} ELSE {DEFAULT_CONFIDENCE} END "
             f"AS DOUBLE) AS llm_confidence"]
    return ",\n       ".join(cols)


def enrichment_report(df: DataFrame, dims: list[str], measures: dict[str, tuple[str, str]], cross: tuple[str, str] | None = None) -> DataFrame:
    """Every distribution of an enriched frame from one
    aggregation over GROUPING SETS: one set per dimension, the cells and margins
    of one crosstab, and the whole.  Rows (dimension, label, other, n, pct,
    measures): ``dimension`` is 'total' for the whole and 'a x b' for a cell; a
    measure is the mean of a column or the count of its true values."""
    sets = [[c] for c in dims] + ([[*cross]] if cross else []) + [[]]
    agg = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*dims).alias("__set"),
        *[(F.avg(c) if kind == "mean" else F.count_if(F.col(c))).alias(name) for name, (kind, c) in measures.items()])
    bits = {c: 1 << (len(dims) - 1 - i) for i, c in enumerate(dims)}              # a bit of grouping_id is set where the column is not in the set
    full = (1 << len(dims)) - 1
    rows = [F.when(F.col("__set") == full, F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("label"),
                                                    F.lit(None).cast("string").alias("other")))]
    for c in dims:
        rows.append(F.when(F.col("__set") == full - bits[c], F.struct(F.lit(c).alias("dimension"), F.col(c).alias("label"), F.lit(None).cast("string").alias("other"))))
    if cross:
        a, b = cross
        rows.append(F.when(F.col("__set") == full - bits[a] - bits[b], F.struct(F.lit(f"{a} x {b}").alias("dimension"), F.col(a).alias("label"), F.col(b).alias("other"))))
    out = agg.select(F.coalesce(*rows).alias("d"), "n", *measures)
    whole = F.max(F.when(F.col("d.dimension") == "total", F.col("n"))).over(Window.partitionBy())       # a few dozen rows
    return out.select("d.*", "n", F.round(F.col("n") * 100.0 / whole, 4).alias("pct"), *[F.round(m, 4).alias(m) if kind == "mean" else F.col(m) for m, (kind, _) in measures.items()])


def domain_violations(df: DataFrame) -> DataFrame:
    """Values outside the demanded domains, per dimension."""
    dims = [("seniority_level", SENIORITY_LEVELS), ("functional_area", FUNCTIONAL_AREAS),
            ("salary_expectation", SALARY_EXPECTATIONS)]
    aggs = []
    for c, dom in dims:
        aggs += [F.count(c).alias(f"{c}__n"), F.count_if(~F.col(c).isin(dom)).alias(f"{c}__bad")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("dimension"), F.lit(len(dom)).alias("domain_size"),
                     F.col(f"{c}__n").alias("n_values"), F.col(f"{c}__bad").alias("n_violations"))
            for c, dom in dims]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
