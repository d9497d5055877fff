"""Replies of a model to batched prompts (M4-M6, C3, H13, H14): a parser that
takes whatever JSON comes back.

A reply becomes a VARIANT (``try_parse_json``), its records an array of VARIANT
(object with ``results``, bare list, or one object; code fences are stripped
first), and each field is read by itself with a default
(``try_variant_get``): a field of the wrong type, or missing, costs that field
only.  The position of a record in its reply is carried along, and records
meet the items of their batch by (batch, position); what a long reply has too
much is dropped, what a short one lacks is unanswered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.features import strip_code_fence

# The fields of a description record with the defaults of a missing
# field, the record of a reply that is missing or not JSON, and the fill of items without an answer.
TEXTS = {"seniority_level": "Unknown", "functional_area": "Other", "salary_expectation": "Medium", "management_level": "None",
         "responsibility_level": "Medium"}
FLAGS = ["has_leadership", "has_strategic_role", "has_budget_responsibility", "has_client_facing", "requires_technical_skills"]
FALLBACK = {"seniority_level": "Mid Level", "functional_area": "Other", "salary_expectation": "Medium", "management_level": "None",
            "responsibility_level": "Medium", "years_experience": "Unknown", "education_level": "Other", "key_skills": ""}
FALLBACK_NOTES = {"parse_error": "Fallback due to parsing error", "no_reply": "Fallback due to query error"}
FALLBACK_CONFIDENCE = {"parse_error": 0.5, "no_reply": 0.0}
DESCRIPTION_FIELDS = [*TEXTS, "years_experience", *FLAGS, "education_level", "key_skills", "validation_notes", "confidence"]
TITLE_FIELDS = ["seniority_level", "functional_area", "salary_expectation", "confidence"]


def parse_records(reply: Column) -> tuple[Column, Column]:
    """(array of VARIANT records, status): 'ok', 'parse_error' or 'no_reply'."""
    json = F.try_parse_json(strip_code_fence(reply))
    kind = F.schema_of_variant(json)
    records = F.when(kind.startswith("ARRAY"), F.try_variant_get(json, "$", "array<variant>")).when(
        kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(json, "$.results", "array<variant>"), F.array(json)))
    status = F.when(reply.isNull(), "no_reply").when(records.isNull(), "parse_error").otherwise("ok")
    return records, status


def years_text(value: Column) -> Column:
    """The number in a text or a number, as text; 'Unknown' without one."""
    found = F.regexp_extract(F.coalesce(value, F.lit("")), r"[0-9]+(\.[0-9]+)?", 0)
    return F.when(found == "", "Unknown").otherwise(F.regexp_replace(found, r"\.0+$", ""))


def read_field(record: Column, name: str) -> Column:
    """One field of a VARIANT record with its default."""
    get = lambda kind: F.try_variant_get(record, f"$.{name}", kind)
    if name in FLAGS:
        return F.coalesce(get("boolean"), F.lit(False))
    if name == "confidence":
        return F.coalesce(get("double"), F.lit(0.0))
    if name == "years_experience":
        return years_text(get("string"))
    if name == "key_skills":
        return F.coalesce(F.array_join(get("array<string>"), ", "), get("string"), F.lit(""))
    return F.coalesce(get("string"), F.lit(TEXTS.get(name, {"education_level": "Other"}.get(name, ""))))


def fallback_field(status: Column, name: str) -> Column:
    """The field where the whole reply is missing or not JSON (M5)."""
    if name in FLAGS:
        return F.lit(False)
    if name in ("confidence", "validation_notes"):
        values = FALLBACK_CONFIDENCE if name == "confidence" else FALLBACK_NOTES
        return F.when(status == "no_reply", values["no_reply"]).otherwise(values["parse_error"])
    return F.lit(FALLBACK[name])


def all_records(replies: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """keys..., pos, status and the fields of every record of every reply; a
    reply without records gives one row, its fallback."""
    records, status = parse_records(F.col("reply"))
    rows = replies.select(*keys, status.alias("status"), F.posexplode_outer(records).alias("pos", "r"))
    ok = F.col("r").isNotNull()
    return rows.select(*keys, F.coalesce("pos", F.lit(0)).alias("pos"), "status",
                       *[F.when(ok, read_field(F.col("r"), f)).otherwise(fallback_field(F.col("status"), f)).alias(f) for f in fields])


def align(items: DataFrame, replies: DataFrame, fields: list[str]) -> DataFrame:
    """Each item (batch_id, pos, ...) with the record at its position.
    ``status`` is that of its reply, or 'short_reply' where the reply has no
    such record: then the fields are null (unanswered)."""
    records, status = parse_records(F.col("reply"))
    parsed = replies.select("batch_id", records.alias("__records"), status.alias("__status"))
    j = items.join(parsed, "batch_id", "left").withColumn("__r", F.get("__records", F.col("pos")))       # one row per batch on the right
    state = F.coalesce("__status", F.lit("no_reply"))
    state = F.when((state == "ok") & F.col("__r").isNull(), "short_reply").otherwise(state)
    j = j.withColumn("status", state)
    st = F.col("status")
    value = lambda f: F.when(st == "ok", read_field(F.col("__r"), f)).when(st != "short_reply", fallback_field(st, f))
    return j.select(*items.columns, "status", *[value(f).alias(f) for f in fields])


def fill_unanswered(df: DataFrame, fields: list[str]) -> DataFrame:
    """Nulls by class of the column: flags False, confidence 0.0, others 'Unknown'."""
    flags = [f for f in fields if f in FLAGS]
    text = [f for f in fields if f not in FLAGS and f != "confidence"]
    return df.na.fill(False, subset=flags).na.fill(0.0, subset=["confidence"]).na.fill("Unknown", subset=text)


def json_object(fields: dict[str, Column]) -> Column:
    """JSON text of an object from JSON texts of its values; a null value leaves its field out."""
    parts = F.array_compact(F.array(*[F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def write_replies(records: DataFrame, kinds: list[str]) -> DataFrame:
    """Replies as models give them, one per batch, from records (batch_id, pos,
    JSON text j): the kind of batch b is kinds[b % len(kinds)].  'object', 'list'
    and 'fenced' are whole; 'short' has the first record only, 'long' repeats
    them all, 'single' is the first record itself, 'broken' is cut in the
    middle, 'none' is no reply."""
    per = records.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", "j"))).alias("rs"))      # per_batch records at most
    texts = F.transform("rs", lambda x: x["j"])
    listed = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    whole = lambda a: F.concat(F.lit('{"results": '), listed(a), F.lit("}"))
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("batch_id") % len(kinds) + 1).cast("int"))
    made = {"object": whole(texts), "list": listed(texts), "fenced": F.concat(F.lit("```json\n"), whole(texts), F.lit("\n```")),
            "short": whole(F.slice(texts, 1, 1)), "long": whole(F.concat(texts, texts)), "single": texts[0],
            "broken": F.substring(whole(texts), 1, 25)}
    reply = F.lit(None).cast("string")
    for k, e in made.items():
        reply = F.when(kind == k, e).otherwise(reply)
    return per.select("batch_id", kind.alias("kind"), reply.alias("reply"))
