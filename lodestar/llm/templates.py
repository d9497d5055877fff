"""Line deduplication with a log-template tree of fixed depth.

A line is parsed by its number of tokens, then by its first LEADING tokens,
tokens with a digit standing as a wildcard; that is its leaf.  A line that
recurs by itself (in MIN_DOCS documents) is a template.  In a leaf that recurs
(lines of MIN_DOCS documents) each position keeps its most frequent token if at
least half of the lines have it (a document's equal lines counting once), else
it is a wildcard: a template of the leaf.  A line belongs to it when at least
SIMILAR of its tokens agree; a template with such lines in at least MIN_DOCS
documents is boilerplate, and its lines are dropped from every document.  The
lines it left take the step again.  Where a template has too few lines, the
group is parted by the tokens of one position (the one whose most frequent token
has the largest share under a half) and each part takes the step, until no part
recurs.

Results for odd input: null text has no lines; lines without a word are neither
counted nor dropped; ids are carried as they are (null, repeated); ties of
tokens take the smallest; an empty table gives no rows; other columns are not
read.  Leaves and shapes are known by 64-bit hashes, a shape by both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.base import BROADCAST_ROWS, SPACE, let, lookup, near, query, read, store

LEADING = 3
MIN_DOCS = 10
SIMILAR = 0.7
WILD = "<*>"


def shape(line: Column) -> Column:
    """Tokens joined by one space, those with a digit as a wildcard."""
    return F.regexp_replace(F.trim(F.regexp_replace(line, SPACE, " ")), "[^ ]*[0-9][^ ]*", WILD)


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.concat_ws(" ", F.size(tokens).cast("string"), F.slice(tokens, 1, LEADING)))


def _shapes(docs: DataFrame) -> DataFrame:
    """One row per document and distinct shape: doc_id, doc (one per row of
    ``docs``), row, leaf, h, shape.
    Written once, so lines are normalised once; what follows reads the narrow
    columns, and shape only of one row per shape in a recurring leaf."""
    shapes = F.array_distinct(F.transform(_lines(F.col("text")), shape))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("doc"), shapes.alias("shapes"))
    rows = rows.select("doc_id", "doc", F.explode("shapes").alias("shape"))
    return store(rows.select("doc_id", "doc", F.monotonically_increasing_id().alias("row"), "shape", F.xxhash64("shape").alias("h"),
                             _leaf(F.split("shape", " ")).alias("leaf")), "template-shapes")


def _total(groups: DataFrame) -> int:
    return groups.agg(F.sum("n")).first()[0] or 0


def _groups(lines: DataFrame, name: str) -> DataFrame:
    """g, n (rows of ``lines``), least (documents of its rarest shape), recurs
    (in at least MIN_DOCS documents) of each group."""
    sizes = lines.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("least"))
    docs = lines.select("g", F.explode("who").alias("doc")).distinct().groupBy("g").agg(F.count(F.lit(1)).alias("found"))
    return store(sizes.join(docs, "g").select("g", "n", "least", (F.col("found") >= MIN_DOCS).alias("recurs")), name)


def _documents(rows: DataFrame, held: DataFrame) -> DataFrame:
    """leaf, h, who: the documents of each shape of ``held`` that has fewer than MIN_DOCS."""
    few = F.col("docs") < MIN_DOCS
    if held.count() <= BROADCAST_ROWS:
        of = rows.select("leaf", "h", "doc").join(F.broadcast(held.where(few).select("leaf", "h")), ["leaf", "h"])
    else:
        key = F.concat_ws("|", "leaf", "h").alias("key")
        of = lookup(rows.select("leaf", "h", "doc", key), held.select(key, "docs"), "key", "docs", rows.count(), F.struct("doc", "h")).where(few)
    return of.groupBy("leaf", "h").agg(F.collect_list("doc").alias("who"))


def _recurring_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaf, h, docs of all shapes; and g, leaf, h, docs, who (documents), shape of
    those in a leaf that can recur and has more than shapes that recur by themselves."""
    each = rows.groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("docs"), F.min("row").alias("row"))
    each = store(each, "template-counts")
    leaves = store(each.groupBy("leaf").agg(F.sum("docs").alias("support"), F.count(F.lit(1)).alias("n"), F.min("docs").alias("least"))
                   .where(F.col("support") >= MIN_DOCS), "template-leaves")
    held = lookup(each, leaves, "leaf", "n", _total(leaves), F.col("h")).where(F.col("least") < MIN_DOCS)
    held = store(held.select("leaf", "h", "docs", "row"), "template-held")
    lines = rows.select("row", "shape").join(near(held), "row").join(_documents(rows, held), ["leaf", "h"], "left")
    # a shape that recurs by itself stands for MIN_DOCS documents, whichever they are
    who = F.coalesce("who", F.sequence(F.lit(-MIN_DOCS).cast("bigint"), F.lit(-1).cast("bigint")))
    return each, store(lines.select(F.col("leaf").alias("g"), "leaf", "h", "docs", who.alias("who"), "shape"), "template-lines")


def _round(lines: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The majority step in every group that recurs: the lines its template
    takes, and all the others under the group of the next step.  None at the end."""
    groups = _groups(lines, "template-groups").select("g", "n", (F.col("recurs") & (F.col("least") < MIN_DOCS)).alias("open"))
    if groups.where("open").isEmpty():
        return None
    lines = store(lookup(lines, groups, "g", "n", _total(groups), F.col("h")).where("open").select(*lines.columns), "template-active")
    at = lines.select("g", "docs", F.posexplode(F.split("shape", " ")).alias("pos", "token"))
    tokens = at.groupBy("g", "pos", "token").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("n"))
    slots = tokens.groupBy("g", "pos").agg(F.max("docs").alias("most"), F.sum("docs").alias("all"), F.sum("n").alias("n"), F.min_by("token", F.struct(-F.col("docs"), "token")).alias("token"))
    kept = F.col("most") * 2 >= F.col("all")
    slots = slots.select("g", "pos", "n", F.when(kept, F.col("token")).otherwise(F.lit(WILD)).alias("token"),
                         # where to part lines without a common template: the largest share under a half, else the smallest
                         F.when(F.col("most") < F.col("all"), F.struct((~kept).alias("wild"), F.when(kept, -F.col("most")).otherwise(F.col("most")).alias("share"), -F.col("pos"))).alias("rank"))
    templates = slots.groupBy("g").agg(F.max("n").alias("n"), F.max_by("pos", "rank").alias("part"),
                                       F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("template"))
    agree = let(F.split("shape", " "), lambda t: F.size(F.filter(F.zip_with(t, F.col("template"), lambda a, b: a == b), lambda x: x)) / F.size(t))
    own = lookup(lines, store(templates, "template-slots"), "g", "n", _total(groups.where("open")), F.col("h"))
    own = store(own.select(*lines.columns, "part", (agree >= SIMILAR).alias("mine")), "template-members")
    found = _groups(own.where("mine"), "template-kept").where("recurs").select("g", "recurs")
    own = store(lookup(own, groups.where("open").select("g", "n").join(found, "g", "left"), "g", "n", _total(groups.where("open")), F.col("h")), "template-round")
    found = F.col("recurs").isNotNull()
    taken = F.col("mine") & found
    into = F.when(found, F.col("g")).otherwise(F.xxhash64("g", "part", F.get(F.split("shape", " "), F.col("part"))))
    return own.where(taken).select("leaf", "h", "docs"), own.where(~taken).withColumn("g", into).select(*lines.columns)


def boilerplate(rows: DataFrame) -> DataFrame:
    """leaf, h, docs of the shapes that belong to a recurring template."""
    each, lines = _recurring_lines(rows)
    bad = each.where(F.col("docs") >= MIN_DOCS).select("leaf", "h", "docs")
    while (step := _round(lines)) is not None:
        mine, lines = step
        bad = bad.union(mine.where(F.col("docs") < MIN_DOCS))
    return bad


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without the boilerplate lines, n_lines, n_dropped."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = _shapes(docs)
    bad = store(boilerplate(rows).select("leaf", "h", "docs"), "template-drop")
    if bad.count() <= BROADCAST_ROWS:
        hit = rows.join(F.broadcast(bad.select("leaf", "h")), ["leaf", "h"]).select("doc_id", "h")
    else:
        key = F.concat_ws("|", "leaf", "h").alias("key")
        total = bad.agg(F.sum("docs")).first()[0] or 0
        hit = lookup(rows.select("doc_id", "h", key), bad.select(key, "docs"), "key", "docs", total, F.struct("doc_id", "h")).where("docs is not null")
    per_doc = store(hit.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("h").alias("gone")), "template-gone")
    if (per_doc.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_ROWS:
        per_doc = F.broadcast(per_doc)                # texts then stay where they are
    out = docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["__id"]), "left")
    keep = F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("gone", F.xxhash64(shape(x)))))
    n = F.size(_lines(F.col("text"))).cast("bigint")
    out = out.withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n")))
    dropped = F.when(F.col("gone").isNull(), F.lit(0).cast("bigint")).otherwise(n - F.size(_lines(F.col("kept"))))
    return out.select("doc_id", F.col("kept").alias("text"), n.alias("n_lines"), dropped.alias("n_dropped"))


@query("op6_line_templates", f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
s AS (SELECT DISTINCT doc_id, regexp_replace(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '{WILD}', 'g') AS shape
      FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
t AS (SELECT doc_id, shape, string_split(shape, ' ') AS tokens FROM s),
f AS (SELECT doc_id, shape, tokens, concat_ws(' ', len(tokens)::VARCHAR, array_to_string(tokens[1:{LEADING}], ' ')) AS leaf FROM t),
r AS (SELECT leaf FROM f GROUP BY leaf HAVING count(*) >= {MIN_DOCS}),
d AS (SELECT leaf, shape, any_value(tokens) AS tokens, count(*) AS docs FROM f WHERE leaf IN (SELECT leaf FROM r) GROUP BY leaf, shape),
p AS (SELECT leaf, docs, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM d),
c AS (SELECT leaf, pos, token, sum(docs) AS docs FROM p GROUP BY leaf, pos, token),
m AS (SELECT leaf, pos, CASE WHEN max(docs) * 2 >= sum(docs) THEN arg_min(token, (-docs, token)) ELSE '{WILD}' END AS token FROM c GROUP BY leaf, pos),
a AS (SELECT x.leaf, x.shape, x.docs FROM
        (SELECT leaf, shape, docs, tokens, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM d) x
        JOIN m ON m.leaf = x.leaf AND m.pos = x.pos
        GROUP BY x.leaf, x.shape, x.docs HAVING sum((m.token = x.token)::INT) / count(*) >= {SIMILAR}),
bad AS (SELECT shape FROM a WHERE leaf IN (SELECT leaf FROM a GROUP BY leaf HAVING sum(docs) >= {MIN_DOCS})),
i AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
j AS (SELECT doc_id, text, line, k, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS full_line,
             regexp_replace(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '{WILD}', 'g') AS shape FROM i),
g AS (SELECT *, full_line AND shape IN (SELECT shape FROM bad) AS gone FROM j)
SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_templates(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
