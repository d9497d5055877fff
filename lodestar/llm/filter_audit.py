"""Filter interaction audit: what each of k filters takes away, alone and after
any of the others, for all k! orders, from one pass over the texts.

Each document becomes a mask of the filters it fails; per part the documents are
counted by mask (2^k cells at most, with their good and toxic documents).  A
Gray-code walk then visits all 2^k sets of active filters and toggles one filter
a step: each cell keeps the number of active filters it fails, and leaves or
rejoins the running survivors when that number leaves or reaches zero.  The 2^k
stored states answer every order: a step is the difference of two of them.

The filters of the audit query, on words ``[^\\x20\\x09-\\x0D]+`` of whole texts:
A under 100 words; B distinct words below 80 % of the words; C ``[A-Z]`` above
10 % of the code points; D any of ``#$%&*|``; E the text of a document with a
smaller id, anywhere in the table.

Results for odd input: a null text is empty (and equal to other empty ones); a
null part is the empty string; rows that share an id count each, and none of
them is the copy of another; a null id is never smaller, nor larger, than
another, so E does not fail it and it makes no other fail; several label rows
of an id count as good (toxic) if one of them is; labels without a document and
documents without a label change nothing else; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.base import let, query, read, words

COUNTS = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    few_or_dull = let(words(text), lambda w: F.struct(
        (F.size(w) < 100).alias("A"), (100 * F.size(F.array_distinct(w)) < 80 * F.size(w)).alias("B")))
    return {"AB": few_or_dull, "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, part, text digest and the mask of
    the filters A to D that the text fails (bit 0 is A)."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    f = text_filters(F.col("text"))
    found = found.select("doc_id", "part", F.sha2("text", 256).alias("digest"), f["AB"].alias("ab"), f["C"].alias("c"), f["D"].alias("d"))
    bit = lambda failed, k: F.when(failed, F.lit(1 << k)).otherwise(F.lit(0))
    return found.select("doc_id", "part", "digest", (bit(F.col("ab.A"), 0) + bit(F.col("ab.B"), 1) + bit(F.col("c"), 2)
                                                     + bit(F.col("d"), 3)).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame, copy_bit: int = 4) -> DataFrame:
    """part, mask (with the bit of copies), n, good, toxic.

    Rows are counted by (id, text) before the labels join, so an id with very
    many rows is a few rows there; then by text, part and label with the
    smallest id and the rows that have it.  Only these counts, as many per text
    as it has parts and kinds of labels, meet to find the text's smallest id.
    """
    kinds = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failed.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(kinds, "doc_id", "left").na.fill(False, ["good", "toxic"])
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("n_null"))
    first = F.min("least").over(Window.partitionBy("digest"))
    spared = F.col("n_null") + F.when(F.col("least") == first, F.col("n_least")).otherwise(F.lit(0))
    texts = texts.withColumn("spared", spared)
    both = F.array(F.struct(F.col("mask"), F.col("spared").alias("n")),
                   F.struct((F.col("mask") + F.lit(1 << copy_bit)).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))
    texts = texts.select("part", "good", "toxic", F.inline(both))
    return texts.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(F.lit(0))).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(F.lit(0))).alias("toxic"))


def gray_states(mask: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors of each set of active filters: an array (2^k, columns of
    ``counts``), by a walk that toggles one filter a step."""
    states = np.zeros((1 << k, counts.shape[1]), np.int64)
    failing, left, active = np.zeros(len(mask), np.int64), counts.sum(axis=0), 0
    states[0] = left
    for step in range(1, 1 << k):
        f = (step & -step).bit_length() - 1                 # the bit in which this Gray code differs from the last
        hit = (mask >> f) & 1 == 1
        on = not (active >> f) & 1
        before = failing[hit]
        failing[hit] += 1 if on else -1
        moved = counts[hit][(before == 0) if on else (failing[hit] == 0)].sum(axis=0)
        left = left - moved if on else left + moved
        active ^= 1 << f
        states[active] = left
    return states


def audit_rows(mask: np.ndarray, counts: np.ndarray, names: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) for every order of the filters ``names``."""
    k = len(names)
    states = gray_states(mask, counts, k)
    fails = [int(counts[(mask >> f) & 1 == 1, 0].sum()) for f in range(k)]
    alone = [int(counts[mask == 1 << f, 0].sum()) for f in range(k)]
    rows, total = [], [0] * k
    for order in permutations(range(k)):
        active = 0
        for step, f in enumerate(order, 1):
            gone = states[active] - states[active | 1 << f]
            active |= 1 << f
            total[f] += int(gone[0])
            rows.append(("".join(names[x] for x in order), step, f, int(states[active, 0]), int(gone[0]),
                         fails[f] - int(gone[0]), alone[f], int(gone[1]), int(gone[2])))
    return [(*row[:2], *row[3:], total[row[2]]) for row in rows]


AUDIT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
         "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def _walk(names: str):
    def run(key, table):
        counts = np.stack([table.column(c).to_numpy() for c in COUNTS], axis=1)
        rows = audit_rows(table.column("mask").to_numpy().astype(np.int64), counts, names)
        cols = [list(c) for c in zip(*rows, strict=True)]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        fields = [x.split()[0] for x in AUDIT.split(", ")]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.string()),
                         *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=fields)
    return run


def audit(counted: DataFrame, names: str) -> DataFrame:
    """All orders of the filters ``names`` (bit i of a mask is names[i]) over
    cells (part, mask, n, good, toxic); a part's cells are 2^k rows at most."""
    return counted.groupBy("part").applyInArrow(_walk(names), AUDIT)


ORACLE = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             length(regexp_replace(text, '[^A-Z]+', '', 'g')) as capitals from d),
least as (select text, min(doc_id) as first_id from d group by text),
kind as (select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic
         from labels where doc_id is not null group by doc_id),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
             (case when len(words) < 100 then 1 else 0 end)
             + (case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end)
             + (case when 100 * capitals > 10 * length(w.text) then 4 else 0 end)
             + (case when regexp_matches(w.text, '[#$%&*|]') then 8 else 0 end)
             + (case when w.doc_id > first_id then 16 else 0 end) as mask
      from w join least on least.text = w.text left join kind on kind.doc_id = w.doc_id),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as t(name, b)),
orders as (select a.name || b.name || c.name || d.name || e.name as filter_order
           from f a, f b, f c, f d, f e
           where a.b | b.b | c.b | d.b | e.b = 31),
steps as (select filter_order, step::integer as step, f.b,
                 (select coalesce(sum(g.b), 0) from f g where strpos(filter_order, g.name) < step) as earlier
          from orders, range(1, 6) as r(step), f where f.name = substr(filter_order, step::integer, 1)),
cell as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
         from m group by part, mask),
x as (select part, filter_order, step, b,
             sum(case when mask & (earlier::integer | b) = 0 then n else 0 end) as kept,
             sum(case when mask & earlier::integer = 0 and mask & b > 0 then n else 0 end) as removed,
             sum(case when mask & earlier::integer > 0 and mask & b > 0 then n else 0 end) as redundant,
             sum(case when mask = b then n else 0 end) as unique_fails,
             sum(case when mask & earlier::integer = 0 and mask & b > 0 then good else 0 end) as good_lost,
             sum(case when mask & earlier::integer = 0 and mask & b > 0 then toxic else 0 end) as toxic_lost
      from cell, steps group by part, filter_order, step, b)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, b))::bigint as shapley
from x
"""


@query("op13_filter_audit", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return audit(cells(failures(docs), labels), "ABCDE")
