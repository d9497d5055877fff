"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is ``rate`` times its words gives every document
floor(rate) whole copies and the fraction rate - floor(rate) of one more.  The
fractions are rounded dependently: two documents meet, one randomly passes
words to the other (either way, with odds that keep both expectations) until
one of them has a whole copy or none, and the other carries what is left.  The
words of the pair never change, so neither does the source's total.

The pairs form a reduction tree: documents of a source in order of size are cut
into blocks of FAN_IN by their exact rank; each block folds to one document
with a fraction, and these go up a level, until a source has at most ROOT
left.  At most RESERVE documents a source, spread evenly over its sizes, wait
for the root, where they and what the tree left are rounded from the largest to
the smallest, each taking over the words the ones before were off by; so a
source misses its target by about half of its smallest such document.  Ranks and random draws come
from the keys alone: reruns and retried tasks agree.

Results for odd input: null text has size 0 and takes 0 words; null source is a
source of its own (the last); rows that share id, source and size are one unit
and take the same number of copies; null ids are allowed; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.base import let, lookup, query, read, store, words
from lodestar.operators.ordering import global_index

WEIGHTS = (5, 2, 1)      # by rank of the source, repeating
MAX_COPIES = 3
FAN_IN = 16
ROOT = 16
RESERVE = 32
SEED = 17


def targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source: source_size, units, target.  ``sizes`` has one row per
    source.  A target is min(max_copies * size, level * weight) with the level
    at which the targets add up to all words: sources are taken in the order in
    which a rising level stops them, and the level is that of the first source
    it does not stop."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(float(max_copies)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    t = t.withColumn("try", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    t = t.withColumn("level", F.min(F.when(F.col("try") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "skey", "try")))
                     .over(Window.partitionBy())["try"])
    first = F.coalesce(F.sum("units").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.select("skey", "source_size", "units", first.alias("first"),
                    F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def _uniform(*keys) -> Column:
    return (F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))


def _meet(a: Column, b: Column) -> Column:
    """struct(left, done): of two units (k, s, p) the one that keeps a fraction
    and the one that got whole."""
    def unit(u, p):
        return F.struct(u["k"].alias("k"), u["s"].alias("s"), p.cast("double").alias("p"))

    def result(left, done):
        return F.struct(left.alias("left"), done.alias("done"))

    a_room, a_mass = (F.lit(1.0) - a["p"]) * a["s"], a["p"] * a["s"]
    b_room, b_mass = (F.lit(1.0) - b["p"]) * b["s"], b["p"] * b["s"]
    up, down = F.least(a_room, b_mass), F.least(a_mass, b_room)          # words towards a, words towards b
    to_a = F.when(up + down > 0, _uniform(a["k"], b["k"]) * (up + down) < down).otherwise(F.lit(True))
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.when(
        to_a, F.when(a_room <= b_mass, result(unit(b, F.greatest(zero, (b_mass - a_room) / b["s"])), unit(a, one)))
        .otherwise(result(unit(a, F.least(one, a["p"] + b_mass / a["s"])), unit(b, zero)))
    ).otherwise(
        F.when(a_mass <= b_room, result(unit(b, F.least(one, b["p"] + a_mass / b["s"])), unit(a, zero)))
        .otherwise(result(unit(a, F.greatest(zero, (a_mass - b_room) / a["s"])), unit(b, one))))


def _fold(units: Column) -> Column:
    """Pivotal fold of an array of units: struct(left, done array)."""
    empty = F.filter(units, lambda u: F.lit(False))
    start = F.struct(F.get(units, F.lit(0)).alias("left"), empty.alias("done"))

    def step(acc, u):
        return let(_meet(acc["left"], u), lambda m: F.struct(
            m["left"].alias("left"), F.concat(acc["done"], F.array(m["done"])).alias("done")))

    return F.aggregate(F.slice(units, 2, FAN_IN), start, step)


def _root(units: Column) -> Column:
    """Largest to smallest: whole or none, whichever is nearer to the wanted
    words, which include what the units before were off by."""
    none = F.transform(F.filter(units, lambda u: F.lit(False)), lambda u: F.struct(u["k"], u["s"], u["p"]))
    start = F.struct(F.lit(0.0).alias("carry"), none.alias("done"))

    def step(acc, u):
        want = u["p"] * u["s"] + acc["carry"]
        x = F.when(want * 2 >= u["s"], 1.0).otherwise(0.0)
        return F.struct((want - x * u["s"]).alias("carry"), F.concat(acc["done"], F.array(F.struct(
            u["k"].alias("k"), u["s"].alias("s"), x.alias("p")))).alias("done"))

    return F.aggregate(units, start, step)["done"]


def _blocks(units: DataFrame) -> DataFrame:
    """Units (skey, pos, k, s, p) folded in blocks of FAN_IN positions."""
    grouped = units.groupBy("skey", F.floor(F.col("pos") / FAN_IN).alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("k", "s", "p"))).alias("units"))
    return grouped.select("skey", "pos", _fold(F.col("units")).alias("f"))


def _copies(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    spark = docs.sparkSession
    units = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~")).alias("skey"),
        F.size(words(F.col(text_col))).cast("bigint").alias("size"),
    ).groupBy("doc_id", "source", "skey", "size").agg(F.count(F.lit(1)).alias("m"))
    units = store(units, "mix-units")
    by_source = store(targets(units.groupBy("source", "skey").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("units"))), "mix-targets")
    total = by_source.agg(F.sum("units")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = lookup(units, by_source, "skey", "units", total, F.col("doc_id"))
    rated = rated.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    indexed = store(global_index(rated, ["skey", F.col("size").desc(), F.xxhash64("doc_id"), "doc_id"], "k", None), "mix-ranked")

    place = F.col("k") - F.col("first")
    waits = F.pmod(place, F.greatest(F.lit(2), F.ceil(F.col("units") / RESERVE))) == 1
    units = indexed.where("size > 0 and p > 0").select(
        "skey", place.alias("pos"), "k", (F.col("size") * F.col("m")).cast("double").alias("s"), "p", waits.alias("waits"))
    level, reserve, done = units.where("not waits").drop("waits"), units.where("waits").drop("waits"), []
    while (level.groupBy("skey").count().agg(F.max("count")).first()[0] or 0) > ROOT:
        folded = store(_blocks(level), "mix-level")
        done.append(folded.select(F.explode("f.done").alias("u")))
        level = folded.select("skey", "pos", "f.left.k", "f.left.s", "f.left.p")
    by_size = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("minus"), "k", "s", "p")))
    done.append(level.unionByName(reserve).groupBy("skey").agg(by_size.alias("units")).select(F.explode(_root(F.col("units"))).alias("u")))
    rounded = reduce(DataFrame.unionAll, done).select(F.col("u.k").alias("k"), F.col("u.p").cast("bigint").alias("extra"))
    copies = indexed.join(rounded, "k", "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    return copies.drop("k", "p", "whole", "extra", "units", "first"), by_source, total


def mix_report(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken."""
    copies, _, _ = _copies(docs, id_col, source_col, text_col)
    one_each = copies.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return one_each.select("doc_id", "source", "size", "source_size", "target", "copies",
                           (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """The mixed corpus: every document as many times as its copies say."""
    copies, _, _ = _copies(docs, id_col, source_col, text_col)
    wanted = copies.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                                               F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    size = F.size(words(F.col(text_col))).cast("bigint")
    out = docs.withColumn("__n", size).join(
        wanted, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__size")) & F.col(source_col).eqNullSafe(F.col("__source")))
    return out.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
