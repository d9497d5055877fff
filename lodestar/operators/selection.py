"""Exact order statistics by selection instead of a sort.

Pass one sketches each group's values (``percentile_approx``, a bounded
summary per task) and brackets every wanted rank between two values of the
sketch, wide enough that the sketch's error cannot push the rank out.  Pass
two aggregates the column once more: a row that no bracket holds only adds one
to the number of values below the brackets above it, so it vanishes in the
map-side partial aggregate; a row inside a bracket is counted under its value.
What is left, some SPAN of the group's rows per rank with equal values
collapsed, is accumulated in value order until the rank is reached.  Nothing
row-sized is shuffled, sorted or joined.

A group of at most EXACT rows has no sketch error to speak of but ranks that
lie closer together than the sketch's steps: its brackets are open and hold all
of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 20_000        # sketch error: a rank is off by at most 1/ACCURACY of the rows
SPAN = 5 / ACCURACY      # half the width of a bracket, as a share of the rows
EXACT = 50_000           # beyond so many rows, SPAN is over 10 ranks wide
UNROLLED = 8             # probabilities compared one by one in generated code; more are a loop over the array
GROUPS = 100_000         # groups up to which their brackets are broadcast


def _null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join with one row per group on the right; null is a group like others."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by]
    return left.join(renamed, on, how).drop(*[f"__r_{c}" for c in by])


def brackets(values: DataFrame, value: str, probs: list[float], by: list[str]) -> DataFrame:
    """by..., __n (non-null values), __closed, and per probability the ends of
    its bracket: __los, __his."""
    ends = [e for p in probs for e in (max(0.0, p - SPAN), min(1.0, p + SPAN))]
    got = values.groupBy(*by).agg(F.count(value).alias("__n"), F.percentile_approx(value, ends, ACCURACY).alias("__e"))
    side = lambda k: F.filter("__e", lambda _, i: i % 2 == k)
    return got.select(*by, "__n", (F.col("__n") > EXACT).alias("__closed"), side(0).alias("__los"), side(1).alias("__his"))


def _marked(values: DataFrame, value: str, ends: DataFrame, k: int, by: list[str]) -> DataFrame:
    """One row per (group, number of brackets that begin at or below the value,
    value if a bracket holds it): how many rows."""
    v, los, his = F.col(value), F.col("__los"), F.col("__his")
    if k <= UNROLLED:
        begun: Column = reduce(lambda a, b: a + b, [(los[i] <= v).cast("int") for i in range(k)])
    else:
        begun = F.size(F.filter(los, lambda lo: lo <= v))
    rows = _null_safe(values, ends, by).withColumn("__j", F.when(F.col("__closed"), begun).otherwise(F.lit(1)))
    held = ~F.col("__closed") | ((F.col("__j") > 0) & (v <= his[F.greatest(F.col("__j"), F.lit(1)) - 1]))
    return rows.select(*by, "__j", F.when(held, v).alias("__v")).groupBy(*by, "__j", "__v").agg(F.count(F.lit(1)).alias("__c"))


def select_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str]) -> DataFrame:
    """by..., p_index, q: linear interpolation between the two neighbouring
    order statistics.  Groups without a non-null value have no rows."""
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    k = len(order)
    values = df.select(*by, value).where(F.col(value).isNotNull())
    ends = brackets(values, value, [float(probs[i]) for i in order], by).checkpoint()       # one row per group, read by both sides below
    if by and ends.count() <= GROUPS:
        ends = F.broadcast(ends)
    marked = _marked(values, value, ends, k, by)
    steps = marked.groupBy(*by, "__j").agg(F.sum("__c").alias("__c"))
    steps = steps.groupBy(*by).agg(F.collect_list(F.struct("__j", "__c")).alias("__steps"))      # k + 1 at most

    # values in value order within their bracket (an open group is one), and the ranks each of them holds
    i = F.col("__i")
    mine = F.when(F.col("__closed"), F.filter(F.sequence(F.lit(1), F.col("__j")), lambda x: F.col("__his")[x - 1] >= F.col("__v")))
    held = _null_safe(marked.where("__v is not null"), ends, by).select(*by, "__n", "__closed", "__v", "__c",
                                                                      F.explode(F.coalesce(mine, F.array(F.lit(1)))).alias("__i"))
    up_to = Window.partitionBy(*by, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    held = _null_safe(held.withColumn("__s", F.sum("__c").over(up_to)), steps, by)
    below = F.aggregate(F.filter("__steps", lambda x: x["__j"] < i), F.lit(0).cast("bigint"), lambda a, x: a + x["__c"])
    held = held.withColumn("__end", F.when(F.col("__closed"), below).otherwise(F.lit(0)) + F.col("__s"))
    wanted = F.array(*[F.struct(F.lit(x).alias("p_index"), F.lit(float(probs[x])).alias("p"), F.lit(n + 1).alias("i")) for n, x in enumerate(order)])
    holds = lambda rank: (F.col("__end") > rank) & (F.col("__end") - F.col("__c") <= rank)
    at = lambda x: x["p"] * (F.col("__n") - 1)
    here = F.filter(wanted, lambda x: (~F.col("__closed") | (x["i"] == i)) & (holds(F.floor(at(x))) | holds(F.ceil(at(x)))))
    held = held.select(*by, "__n", "__v", "__c", "__end", F.inline(here))
    rank = F.col("p") * (F.col("__n") - 1)
    picked = held.groupBy(*by, "p_index").agg(F.max(F.when(holds(F.floor(rank)), F.col("__v"))).alias("__a"),
                                              F.max(F.when(holds(F.ceil(rank)), F.col("__v"))).alias("__b"),
                                              F.first(rank - F.floor(rank)).alias("__f"))
    # every rank is answered: one outside its bracket would mean a sketch off by more than its error
    every = ends.where("__n > 0").select(*by, F.explode(F.array(*[F.lit(x) for x in range(k)])).alias("p_index"))
    out = _null_safe(every, picked, [*by, "p_index"], "left")
    missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    q = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")
    return out.select(*by, "p_index", F.when(F.col("__a").isNull() | F.col("__b").isNull(), missed).otherwise(q).alias("q"))
