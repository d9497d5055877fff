"""Enrichment rules, reply parsing, fallbacks and positional alignment on fixtures."""

import json

from pyspark.sql import functions as F

from lodestar.operators import enrich as en
from lodestar.operators import replies as rep


def test_title_rules(spark):
    titles = [("Junior Sales Associate",), ("Director of Marketing",), ("Senior Project Manager",),
              ("HR Manager",), ("Product Designer",), ("Data Scientist",), ("Software Engineer",),
              ("Receptionist",), ("Senior Financial Analyst",), ("Customer Service Rep",)]
    df = spark.createDataFrame(titles, "t string")
    got = {r["t"]: r for r in en.classify_titles(df, "t").collect()}
    assert got["Junior Sales Associate"]["seniority_level"] == "Entry Level"
    assert got["Junior Sales Associate"]["functional_area"] == "Sales_Marketing"
    assert got["Director of Marketing"]["seniority_level"] == "Executive"
    assert got["Senior Project Manager"]["seniority_level"] == "Senior Level"
    assert got["Senior Project Manager"]["functional_area"] == "Operations"
    assert got["HR Manager"]["functional_area"] == "HR"
    assert got["Product Designer"]["functional_area"] == "Product"
    assert got["Data Scientist"]["functional_area"] == "Technology"
    assert got["Software Engineer"]["functional_area"] == "Technology"
    assert got["Receptionist"]["seniority_level"] == "Mid Level"
    assert got["Receptionist"]["functional_area"] == "Other"
    assert got["Receptionist"]["confidence"] == en.DEFAULT_CONFIDENCE
    assert got["Senior Financial Analyst"]["salary_expectation"] == "High"
    assert got["Customer Service Rep"]["functional_area"] == "Customer_Service"
    for r in got.values():
        assert r["seniority_level"] in en.SENIORITY_LEVELS
        assert r["functional_area"] in en.FUNCTIONAL_AREAS
        assert r["salary_expectation"] in en.SALARY_EXPECTATIONS


def test_word_edges_do_not_match_inside_words(spark):
    df = spark.createDataFrame([("Digital Editor",), ("Submitter",)], "t string")
    got = {r["t"]: r["functional_area"] for r in en.classify_titles(df, "t").collect()}
    assert got == {"Digital Editor": "Other", "Submitter": "Other"}   # "it" only as a word


def test_reply_shapes(spark):
    item = {"job_title": "a", "seniority_level": "Senior Level", "functional_area": "HR",
            "salary_expectation": "High", "confidence": 0.8}
    replies = [
        (1, json.dumps({"results": [item]})),
        (2, json.dumps([item])),
        (3, json.dumps(item)),
        (4, "```json\n" + json.dumps({"results": [item]}) + "\n```"),
        (5, "this is not json"),
        (6, ""),
        (7, None),
        (8, "12"),
        (9, json.dumps({"results": []})),
        (10, json.dumps([item, "not an object", None, {"functional_area": 7, "confidence": "high"}])),
    ]
    df = spark.createDataFrame(replies, "id int, reply string")
    records, status = rep.parse_records(F.col("reply"))
    got = {r["id"]: (r["s"], r["n"]) for r in df.select("id", status.alias("s"), F.size(records).alias("n")).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), ("ok", 1))
    assert [got[i][0] for i in (5, 6, 7, 8, 9, 10)] == ["parse_error", "parse_error", "no_reply", "parse_error", "ok", "ok"]
    rows = {}
    for r in rep.all_records(df, rep.TITLE_FIELDS, ["id"]).collect():
        rows.setdefault(r.id, []).append((r.pos, *[r[f] for f in rep.TITLE_FIELDS]))
    assert rows[1] == rows[4] == [(0, "Senior Level", "HR", "High", 0.8)]
    assert rows[5] == [(0, "Mid Level", "Other", "Medium", 0.5)] and rows[7] == [(0, "Mid Level", "Other", "Medium", 0.0)]
    # what is no object, or of another type, costs its fields only
    assert sorted(rows[10]) == [(0, "Senior Level", "HR", "High", 0.8), (1, "Unknown", "Other", "Medium", 0.0), (2, "Unknown", "Other", "Medium", 0.0),
                                (3, "Unknown", "7", "Medium", 0.0)]


def test_short_reply_alignment_and_fallbacks(spark):
    items = spark.createDataFrame([(0, 0, "t0"), (0, 1, "t1"), (0, 2, "t2"), (1, 0, "t3"), (2, 0, "t4"), (3, 0, "t5")],
                                  "batch_id bigint, pos int, t string")
    one = {"job_title": "t0", "seniority_level": "Executive", "functional_area": "Finance",
           "salary_expectation": "Very_High", "confidence": 0.9}
    replies = spark.createDataFrame([(0, json.dumps({"results": [one]})), (1, "garbage"), (3, json.dumps([one, one]))],
                                    "batch_id bigint, reply string")
    got = {r["t"]: r for r in rep.align(items, replies, rep.TITLE_FIELDS).collect()}
    assert len(got) == 6
    assert got["t0"]["status"] == "ok" and got["t0"]["seniority_level"] == "Executive"
    assert got["t1"]["status"] == "short_reply" and got["t1"]["seniority_level"] is None
    assert got["t3"]["status"] == "parse_error" and got["t3"]["confidence"] == 0.5
    assert got["t4"]["status"] == "no_reply" and got["t4"]["confidence"] == 0.0
    assert got["t5"]["status"] == "ok"                                    # a long reply: what is too much is dropped


def test_description_fields(spark):
    full = {"seniority_level": "Executive", "functional_area": "HR", "salary_expectation": "High", "management_level": "Director",
            "responsibility_level": "High", "years_experience": 12, "has_leadership": True, "has_strategic_role": "true", "has_budget_responsibility": 0,
            "has_client_facing": "maybe", "requires_technical_skills": None, "education_level": "PhD", "key_skills": ["sql", "excel"],
            "validation_notes": "clear", "confidence": 0.75}
    texts = [full, {}, {"years_experience": "5-7 years", "key_skills": "sql", "confidence": "0.5"}, {"years_experience": 2.5, "key_skills": []},
             {"years_experience": "Unknown", "key_skills": [1, "a"]}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)], "id int, reply string")
    got = {r.id: r for r in rep.all_records(df, rep.DESCRIPTION_FIELDS, ["id"]).collect()}
    assert len(rep.DESCRIPTION_FIELDS) == 15
    assert (got[0].years_experience, got[0].key_skills, got[0].has_leadership, got[0].has_strategic_role) == ("12", "sql, excel", True, True)
    assert (got[0].has_budget_responsibility, got[0].has_client_facing, got[0].requires_technical_skills) == (False, False, False)
    assert [got[1][f] for f in rep.DESCRIPTION_FIELDS] == ["Unknown", "Other", "Medium", "None", "Medium", "Unknown", *[False] * 5, "Other", "", "", 0.0]
    assert [got[i].years_experience for i in (2, 3, 4)] == ["5", "2.5", "Unknown"]
    assert [got[i].key_skills for i in (2, 3, 4)] == ["sql", "", "1, a"] and got[2].confidence == 0.5


def test_report_counts_every_set(spark):
    rows = [("a", "x", True, 1.0), ("a", "y", False, 3.0), ("b", "x", True, 5.0), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "p string, q string, f boolean, v double")
    got = {(r.dimension, r.label, r.other): (r.n, r.pct, r.flags, r.mean_v)
           for r in en.enrichment_report(df, ["p", "q"], {"flags": ("count", "f"), "mean_v": ("mean", "v")}, ("p", "q")).collect()}
    assert got == {("total", None, None): (4, 100.0, 2, 3.0), ("p", "a", None): (2, 50.0, 1, 2.0), ("p", "b", None): (1, 25.0, 1, 5.0),
                   ("p", None, None): (1, 25.0, 0, None), ("q", "x", None): (3, 75.0, 2, 3.0), ("q", "y", None): (1, 25.0, 0, 3.0),
                   ("p x q", "a", "x"): (1, 25.0, 1, 1.0), ("p x q", "a", "y"): (1, 25.0, 0, 3.0), ("p x q", "b", "x"): (1, 25.0, 1, 5.0),
                   ("p x q", None, "x"): (1, 25.0, 0, None)}


def test_titles_and_descriptions_have_rules_of_their_own(spark):
    df = spark.createDataFrame([("Technical Writer",), ("Head of Department",), ("Budgeting Officer",)], "t string")
    got = {r["t"]: r for r in en.classify_titles(df, "t").collect()}
    assert {r["functional_area"] for r in got.values()} == {"Other"} and got["Head of Department"]["seniority_level"] == "Mid Level"
    told = {r["t"]: r for r in en.describe_text(df, "t", "t").collect()}
    assert told["Technical Writer"]["llm_functional_area"] == "Technology" and told["Head of Department"]["llm_seniority"] == "Executive"


def test_map_back_defaults(spark):
    rows = spark.createDataFrame([(1, "Junior Analyst"), (2, "Unseen Title"), (3, None)], "id int, t string")
    cls = en.classify_titles(spark.createDataFrame([("Junior Analyst",)], "t string"), "t")
    got = {r["id"]: r for r in en.map_back(rows, "t", cls).collect()}
    assert got[1]["llm_seniority"] == "Entry Level"
    assert got[2]["llm_seniority"] == "Unknown" and got[2]["llm_confidence"] == 0.0
    assert got[3]["llm_functional_area"] == "Other"


def test_model_completion_with_retries(spark):
    calls = {"n": 0}

    def flaky(prompt):
        if "fail" in prompt:
            raise RuntimeError("down")
        return json.dumps({"results": []})

    prompts = spark.createDataFrame([(0, "ok prompt"), (1, "fail prompt")], "batch_id bigint, prompt string")
    got = {r["batch_id"]: r["reply"] for r in en.model_replies(prompts, flaky).collect()}
    assert got[0] == json.dumps({"results": []})
    assert got[1] is None


def test_description_attributes(spark):
    docs = spark.createDataFrame([
        (1, "We need a Director with 20 years of experience, a PhD and strong budget skills. Python and SQL."),
        (2, "Junior role, 10 years required, bachelor degree, customer support."),
        (3, "Senior engineer position; no years stated."),
        (4, None),
        (5, "We need an analyst with 20 years of experience."),
        (6, "Junior clerk, a firm with 30 years of history. It is a pronoun."),
        (7, "Senior role in IT, 100 years of history and 2 years required.")], "id int, text string")
    got = {r["id"]: r for r in en.describe_text(docs, "id", "text").collect()}
    assert got[1]["llm_seniority"] == "Executive"
    assert got[1]["llm_management_level"] == "Director"
    assert got[1]["llm_years_experience"] == "20"
    assert got[1]["llm_education_level"] == "PhD"
    assert got[1]["llm_has_budget_responsibility"] is True
    assert got[1]["llm_key_skills"] == "python, sql"
    # stated years lower a level that does not allow them, they never raise one
    assert got[2]["llm_seniority"] == "Entry Level"
    assert got[5]["llm_seniority"] == "Mid Level"
    assert (got[6]["llm_seniority"], got[6]["llm_functional_area"]) == ("Entry Level", "Other")
    assert (got[7]["llm_seniority"], got[7]["llm_functional_area"]) == ("Entry Level", "Technology")
    assert got[7]["llm_years_experience"] == "2"
    assert got[7]["llm_validation_notes"] == "level set from stated years"
    assert got[3]["llm_years_experience"] == "Unknown"
    assert got[4]["llm_seniority"] == "Mid Level"


def test_single_scan_matches_per_rule_sql(spark):
    """The one-scan-per-family Spark path equals the per-rule SQL twin on
    texts that do contain keywords (the driver's tables contain few)."""
    import duckdb
    texts = [(1, "Head of Department and team lead; customer service, data scientist. 3 years."),
             (2, "HEAD OF sales, Senior Project Manager with 16-years; MBA; clients & budgeting; R&D"),
             (3, "leadership? lead! managing the CTO office, high school, Excel/SQL, communication"),
             (4, "édirector vp_ceo intern-trainee product owner, accounting audit, Técnico: software"),
             (5, "line one\nJunior\tassistant\nlast line manager\n"),
             (7, "customer service lead, data scientist with data; client relations for clients; Leadership"),
             (8, "team lead, head of operations, people management; doctorate; java and python; strategic budget"),
             (6, "")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = sorted(tuple(r) for r in en.describe_text(df, "doc_id", "text").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", texts)
    res = con.execute("SELECT " + en.sql_describe_text("doc_id", "text") + " FROM d")
    cols = [x[0] for x in res.description]
    assert cols == en.describe_text(df, "doc_id", "text").columns
    want = sorted(tuple(r) for r in res.fetchall())
    assert got == want
