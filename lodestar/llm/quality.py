"""Quality by weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on each document.  Expectation
maximisation over the counts of vote patterns (all documents; at most
3^rules rows reach the driver) estimates for each rule how often it says bad of
a bad document and of a good one, and the share of good documents; the
posterior that a document is good decides, not a list of tests all of which
must pass.  Everything on the executors is built-in column expressions.

Results for odd input: null text has no words, so its base tests fail and it is
not kept; ids are carried as they are (null, repeated); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.base import SPACE, let, query, read, store, words

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
KEEP_AT = 0.5              # posterior from which a document is kept
EM_ROUNDS = 50
WORST_GOOD = 0.03          # a rule calls at most this share of good documents bad,
BEST_BAD = 0.2             # and at least this share of bad ones; EM estimates within these bounds
FEW = 64                   # up to so many distinct repeated windows are looked up in a list


def repeated_words(ws: Column, k: int = 3) -> Column:
    """Words inside k-word windows that occur twice or more.

    Window hashes are sorted with their low bits replaced by the position, so
    equal windows become neighbours in one sort of longs.  Texts too long for
    the position bits sort (hash, position) pairs instead.
    """
    bits = 20
    n = F.size(ws)

    def covered(pos: Column) -> Column:      # ascending window starts -> number of covered words
        return F.aggregate(F.transform(pos, lambda p, i: F.when(i == 0, F.lit(k)).otherwise(
            F.least(F.lit(k), p - F.get(pos, i - 1)))), F.lit(0), lambda a, x: a + x)

    def from_hashes(h: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            def from_repeats(r: Column) -> Column:
                listed = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(r, F.get(h, i)))
                return F.when(F.size(r) == 0, F.lit(0)).otherwise(
                    let(F.when(F.size(r) <= FEW, listed).otherwise(paired(h)), covered))
            return let(F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))), from_repeats)
        return let(F.sort_array(h), from_sorted)

    def paired(h: Column) -> Column:         # starts of repeated windows by one sort
        def short(s):
            keep = F.lit(-(1 << bits)).cast("bigint")

            def same(i, j):
                a, b = F.get(s, i), F.get(s, j)
                low = F.lit((1 << bits) - 1)
                return ((a.bitwiseAND(keep) == b.bitwiseAND(keep))
                        & (F.get(h, a.bitwiseAND(low).cast("int")) == F.get(h, b.bitwiseAND(low).cast("int"))))
            hit = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")))

        def long_(s):
            hit = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                           | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-(1 << bits)).cast("bigint")).bitwiseOR(i.cast("bigint"))))
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) < (1 << bits), let(packed, short)).otherwise(let(pairs, long_))

    hashes = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))
    return F.when(n < k + 1, F.lit(0)).otherwise(let(hashes, from_hashes)).cast("bigint")


def measures(text: Column) -> Column:
    """Struct of the measures of one text."""
    def of_text(t: Column) -> Column:
        ws, lines = words(t), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def drop(chars):
            return F.char_length(F.regexp_replace(t, chars, "")).cast("bigint")
        return let(ws, lambda w: let(lines, lambda ln: F.struct(
            F.size(w).cast("bigint").alias("n_words"), drop(SPACE).alias("word_chars"),
            drop(r"[^#*$%&|<>]+").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("bigint").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(ln).cast("bigint").alias("n_lines"),
            F.size(F.filter(w, lambda x: x.rlike(r"[.!?]$"))).cast("bigint").alias("n_ends"),
            F.size(F.filter(w, lambda x: x.rlike(r"[#*$%&|<>]"))).cast("bigint").alias("n_symbol_words"),
            drop(r"[^!?]+").alias("n_marks"), drop(r"[^0-9]+").alias("n_digits"), drop(r"[^\p{Lu}]+").alias("n_upper"))))
    return let(F.coalesce(text, F.lit("")), of_text)


NEVER = "false"
RULES = {   # name: (votes bad when, votes good when); else it abstains.  A rule that looks for one kind of junk says nothing in its absence.
    "length": ("n_words < 50", "n_words >= 100"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars >= 4 * n_words and word_chars <= 9 * n_words"),
    "sentences": ("n_ends < 0.01 * n_words", "n_ends >= 0.02 * n_words"),
    "symbols": ("n_symbols > 0.1 * n_words", NEVER),
    "symbol_words": ("n_symbol_words > 0.2 * n_words", NEVER),
    "dup_lines": ("n_dup_lines > 0.3 * n_lines", NEVER),
    "repeats": ("n_repeat_words > 0.4 * n_words", NEVER),
    "marks": ("n_marks > 0.3 * n_words", NEVER),
    "digits": ("n_digits > 0.2 * word_chars", NEVER),
    "upper": ("n_upper > 0.4 * word_chars", NEVER),
}


def _vote(bad: str, good: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """EM on (votes, count) rows: share of good documents and, per rule, the
    probabilities of a bad vote given a bad and given a good document.  Starts
    from rules that are better than chance and keeps them so, which fixes which
    class is which."""
    k = len(patterns[0][0]) if patterns else len(RULES)
    good, rates = 0.8, [(0.6, WORST_GOOD)] * k
    for _ in range(rounds):
        mass, bad, voted = [0.0, 0.0], [[0.0, 0.0] for _ in range(k)], [[0.0, 0.0] for _ in range(k)]
        for votes, n in patterns:
            p = posterior(votes, good, rates)
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                mass[c] += w
                for j, v in enumerate(votes):
                    if v:
                        voted[j][c] += w
                        bad[j][c] += w * (v < 0)
        good = min(0.98, max(0.2, (mass[1] + 8) / (sum(mass) + 10)))
        rates = []
        for j in range(k):          # ten earlier votes of each class as a prior
            b = (bad[j][0] + 6) / (voted[j][0] + 10)
            g = (bad[j][1] + 0.5) / (voted[j][1] + 10)
            g = min(WORST_GOOD, max(0.001, g))
            rates.append((min(0.99, max(b, BEST_BAD)), g))
    return good, rates


def posterior(votes, good: float, rates) -> float:
    z = math.log(good / (1 - good))
    for v, (b, g) in zip(votes, rates, strict=True):
        z += math.log(g / b) if v < 0 else math.log((1 - g) / (1 - b)) if v > 0 else 0.0
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    measured = store(docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m")).select("doc_id", "m.*")
                     .select("*", *[_vote(*r).cast("byte").alias(f"vote_{n}") for n, r in RULES.items()]), "quality")
    votes = [f"vote_{n}" for n in RULES]
    counted = [(tuple(r[v] for v in votes), r["n"]) for r in measured.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()]
    good, rates = fit(sorted(counted))
    z = F.lit(math.log(good / (1 - good)))
    for v, (b, g) in zip(votes, rates, strict=True):
        z = z + F.when(F.col(v) < 0, math.log(g / b)).when(F.col(v) > 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
    p = 1 / (1 + F.exp(-z))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    return (measured.withColumn("posterior", p).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at)))


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
