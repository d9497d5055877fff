"""Personal data by candidate gradient boosting.

Base patterns with their checks give the certain spans.  High-recall generators
propose further, overlapping candidates: anything around an @, dotted numbers,
long digit strings, phone-like numbers with or without a plus, and long runs
that mix letters and digits (secrets).  Each candidate has format features and
context features.  What makes a candidate positive is evidence that its own
features do not hold: for the four base kinds, that it meets a base span (the
plus that the base pattern of phones demands is no feature, nor is a checksum);
for secrets, that a telling name and an assignment stand before it (their
context features are masked).  So the trees can only tell the format of such
data, and select candidates that have it without the plus, the checksum or the
name.  A phone number without a plus or a secret without a name is not a false
one but an unlabelled one, so the share of labelled ones among the true ones is
estimated from the scores of the labelled ones, and counts are corrected by it;
a number that fails the checksum or the range of its kind is a false one.

Boosted trees learn from all candidates of one half of the documents and score
the other half, and the other way round (only counts per feature pattern reach
the driver, whose number the feature ranges bound).  Over these scores of texts
not learned from, each kind is calibrated by itself: a candidate is selected
from the score at which PRECISION of its kind's candidates are right.  Selected
candidates that overlap no base span are added, best first.  Everything on the
executors is built-in column expressions; the trees become CASE expressions.

Results for odd input: null text counts as empty and has no spans; positions
are code points, ends exclusive; ids are carried as they are, and rows that
share one are judged each by its own text; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.base import let, query, read, store

KINDS = ("email", "ip", "card", "phone")       # of the base patterns
FOUND = (*KINDS, "secret")                      # that spans can have
SECRET = len(KINDS)
UNSEEN = ("phone", "secret")                    # kinds that may lack their evidence; what fails the check of an ip or a card is none
# fixed values: the base patterns, with possessive repeats (the same matches,
# without a retry inside a run that cannot succeed)
_WORD = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_WORD})){_WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?:\G|(?<![^\x20\x09-\x0D@]))[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]{1,4}(?:\.[0-9]{1,4}){2,5}+",
    "card": r"[0-9](?:[\x20.-]?+[0-9]){11,}+",
    "phone": r"[+(]?[0-9][0-9().\x20-]{5,}[0-9]",
    "secret": r"(?:\G|(?<![A-Za-z0-9+/=_-]))[A-Za-z0-9+/=_-]{16,}+",
}
TELLING = r"(?i)(tel|phone|call|fax|card|visa|pay|mail|contact|write|host|server|addr|login)[^\n]{0,16}$"
NAMED = r"(?i)(token|secret|api[_-]?key|passw(or)?d|credential)[a-z_-]*[\"']?\x20?[:=]\x20?[\"']?$"
PRECISION = 0.95
ROUNDS, RATE, LEAST = 30, 0.3, 5        # boosting rounds, shrinkage, candidates of a leaf
SURE = 10                               # candidates of a kind that a cut must rest on


def matches(t: Column, pattern: str, kind: str) -> Column:
    """Array of struct(start, k, end, m) of the non-overlapping matches: the
    pieces between matches give the positions."""
    k = FOUND.index(kind)
    found, pieces = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    empty = F.array().cast("array<struct<start:int,k:int,end:int,m:string>>")

    def place(ms: Column) -> Column:
        def from_pieces(ps: Column) -> Column:
            def step(acc, m):
                i = F.size(acc["out"])
                start = acc["at"] + F.char_length(F.get(ps, i))
                return F.struct((start + F.char_length(m)).alias("at"), F.concat(acc["out"], F.array(F.struct(
                    start.alias("start"), F.lit(k).alias("k"), (start + F.char_length(m)).alias("end"), m.alias("m")))).alias("out"))
            return F.aggregate(ms, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
        return F.when(F.size(ms) == 0, empty).otherwise(let(pieces, from_pieces))
    return let(found, place)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.char_length(d)

    def step(acc, i):
        x = F.substring(d, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return let(digits(m), lambda d: F.when(F.char_length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(digits(m)).between(10, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: valid(kind, s["m"])


def _is(k: int):
    return lambda s: s["k"] == k


def _all(t: Column, patterns: dict[str, str], check: bool) -> Column:
    hit = {"email": "@", "phone": r"\+[0-9]" if check else "[0-9]{2}", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][\x20.-][0-9]",
           "secret": "[A-Za-z0-9+/=_-]{16}"}
    empty = F.array().cast("array<struct<start:int,k:int,end:int,m:string>>")
    parts = []
    for kind, p in patterns.items():
        found = matches(t, p, kind)
        if check:
            found = F.filter(found, _checked(kind))
        elif kind == "secret":
            found = F.filter(found, lambda s: s["m"].rlike("[0-9]") & s["m"].rlike("[A-Za-z]"))
        parts.append(F.when(t.rlike(hit[kind]), found).otherwise(empty))
    return F.array_sort(F.concat(*parts))


def _overlaps(a, b) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


FEATURES = {     # name: number of values
    "kind": 5, "digits": 8, "seps": 5, "run": 6, "paren": 2, "dots": 5, "letters": 4, "length": 8, "before": 5, "after": 5, "telling": 2,
}


def _features(t: Column, s: Column) -> Column:
    m, before = s["m"], F.substring(t, F.greatest(F.lit(1), s["start"] - 31), F.least(s["start"], F.lit(32)))
    last, nxt = F.substring(t, s["start"], F.when(s["start"] > 0, 1).otherwise(0)), F.substring(t, s["end"] + 1, F.lit(1))
    nd, n, secret = F.char_length(digits(m)), F.char_length(m), s["k"] == SECRET
    # the digits of a phone number with a plus are those of one without and a country code: its count is no sign of the plus
    nd = F.when(m.startswith("+"), F.least(nd, F.lit(10))).otherwise(nd)

    def kind_of(c):
        return (F.when(c == "", 0).when(c.rlike(r"[\x20\x09-\x0D]"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4))

    def count(chars, most):
        return F.least(F.lit(most), n - F.char_length(F.regexp_replace(m, chars, "")))
    run = F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda r: F.char_length(r)))
    letters = F.when(~m.rlike("[A-Za-z]"), 0).when(m.rlike("^[0-9a-f]+$"), 1).when(~m.rlike("[A-Z]") | ~m.rlike("[a-z]"), 2).otherwise(3)
    masked = lambda c: F.when(secret, 0).otherwise(c)
    return F.struct(
        s["k"].alias("kind"), F.when(nd < 7, 0).when(nd < 10, 1).when(nd < 12, 2).when(nd < 14, 3).when(nd < 16, 4).when(nd < 17, 5).when(nd < 20, 6).otherwise(7).alias("digits"),
        F.least(F.lit(4), F.greatest(F.lit(0), count(r"[\x20()-]", 9) - F.when(m.startswith("+"), 1).otherwise(0))).alias("seps"),
        F.least(F.lit(5), F.floor(F.coalesce(run, F.lit(0)) / 3).cast("int")).alias("run"),
        m.contains("(").cast("int").alias("paren"), count(r"\.", 4).alias("dots"), letters.alias("letters"),
        F.when(secret, F.when(n < 20, 0).when(n < 24, 1).when(n < 32, 2).when(n < 40, 3).when(n == 40, 4).when(n < 64, 5).when(n == 64, 6).otherwise(7)).otherwise(0).alias("length"),
        masked(kind_of(last)).alias("before"), masked(kind_of(nxt)).alias("after"), masked(before.rlike(TELLING).cast("int")).alias("telling"))


def _named(t: Column, s: Column) -> Column:
    """Evidence of a secret: a telling name and an assignment before it."""
    return F.substring(t, F.greatest(F.lit(1), s["start"] - 31), F.least(s["start"], F.lit(32))).rlike(NAMED)


def _grow(rows, grad, hess, depth):
    """Regression tree on (features, ...) pattern rows with gradient sums: nested (feature, bound, low, high) or a leaf value."""
    g, h = sum(grad), sum(hess)
    best = None
    if depth:
        for f, size in enumerate(FEATURES.values()):
            sums = [[0.0, 0.0] for _ in range(size)]
            for r, a, b in zip(rows, grad, hess, strict=True):
                sums[r[0][f]][0] += a
                sums[r[0][f]][1] += b
            lg = lh = 0.0
            for bound in range(size - 1):
                lg, lh = lg + sums[bound][0], lh + sums[bound][1]
                if min(lh, h - lh) < 1e-3:
                    continue
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, f, bound)
    if best is None:
        return -g / (h + 1) * RATE
    _, f, bound = best
    sides = [[i for i, r in enumerate(rows) if (r[0][f] <= bound) == low] for low in (True, False)]
    if min(sum(rows[i][1] for i in side) for side in sides) < LEAST:
        return -g / (h + 1) * RATE
    return (f, bound, *(_grow([rows[i] for i in s], [grad[i] for i in s], [hess[i] for i in s], depth - 1) for s in sides))


def _value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def boost(rows) -> list:
    """Trees from (features, count, positives) rows, by Newton steps on the log loss."""
    trees, score = [], [0.0] * len(rows)
    for _ in range(ROUNDS if rows else 0):
        p = [_sigmoid(s) for s in score]
        grad = [r[1] * q - r[2] for r, q in zip(rows, p, strict=True)]
        hess = [r[1] * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        trees.append(_grow(rows, grad, hess, 3))
        score = [s + _value(trees[-1], r[0]) for s, r in zip(score, rows, strict=True)]
    return trees


def seen_share(scored) -> float:
    """Of all true candidates of a kind, the share that has the evidence: the mean
    predicted probability over those that have it (true ones show it at random,
    so where every candidate is true the probability is that share)."""
    hits = sum(b for _, _, b in scored)
    return sum(b * _sigmoid(s) for s, _, b in scored) / hits if hits else 1.0


def calibrate(scored, precision: float, share: float = 1.0) -> float:
    """Lowest score from which on the share of true ones among (score, count,
    with evidence) is at least ``precision`` at every cut above; ``share`` of
    the true ones have evidence."""
    scored = sorted(scored, reverse=True)
    n = good = 0
    cut = math.inf
    for i, (s, a, b) in enumerate(scored):
        n, good = n + a, good + b
        if i + 1 < len(scored) and scored[i + 1][0] == s:
            continue
        if good < precision * n * share or n < SURE:
            if n >= SURE:
                break
            continue
        cut = s
    return cut


def _score(trees, f: Column) -> Column:
    names = list(FEATURES)

    def expr(tree):
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(f[names[tree[0]]] <= tree[1], expr(tree[2])).otherwise(expr(tree[3]))
    total = F.lit(0.0)
    for t in trees:
        total = total + expr(t)
    return total


def _best(picks: Column) -> Column:
    """Of overlapping picks the best, then the first: in order of score each is
    kept that overlaps none kept before it."""
    order = F.array_sort(F.transform(picks, lambda c: F.struct((-c["z"]).alias("z"), c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"))))
    return F.aggregate(order, F.array().cast("array<struct<start:int,k:int,end:int>>"), lambda kept, c: F.when(
        F.exists(kept, lambda d: _overlaps(d, c)), kept).otherwise(F.concat(kept, F.array(F.struct(
            c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"))))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """doc_id, tag (hash of the text), base and spans (arrays of struct(start, k,
    end), by start, then kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("tag", F.xxhash64("text"))

    def candidates(t):
        return F.transform(_all(t, GENERATORS, False), lambda s: F.struct(
            s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), _features(t, s).alias("f"), _named(t, s).alias("named")))
    spans = let(F.col("text"), lambda t: F.struct(
        F.transform(_all(t, BASE, True), lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))).alias("base"),
        F.when(t.rlike("[0-9@]"), candidates(t)).alias("more")))
    half = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(2)).alias("half")
    rows = store(plain.where(F.col("text").rlike("[0-9@]")).select("doc_id", "tag", half, spans.alias("s")).select("doc_id", "tag", "half", "s.*"), "pii-candidates")
    one = rows.select("half", "base", F.explode("more").alias("c"))
    met = F.exists("base", lambda b: (b["k"] == F.col("c.k")) & _overlaps(b, F.col("c")))
    one = one.select("half", "c.f.*", F.when(F.col("c.k") == SECRET, F.col("c.named")).otherwise(met).cast("int").alias("hit"))
    counted = one.groupBy("half", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")).collect()
    halves = [sorted((tuple(r[f] for f in FEATURES), r["n"], r["hits"]) for r in counted if r["half"] == h) for h in (0, 1)]
    trees = [boost(halves[1]), boost(halves[0])]            # of a half: learned from the other
    held = [(r[0][0], sum(_value(t, r[0]) for t in trees[h]), r[1], r[2]) for h in (0, 1) for r in halves[h]]
    cuts = []
    for k, kind in enumerate(FOUND):
        own = [x[1:] for x in held if x[0] == k]
        cuts.append(calibrate(own, precision, seen_share(own) if kind in UNSEEN else 1.0) if all(trees) and own else math.inf)

    score = lambda f: F.when(F.col("half") == 0, _score(trees[0], f)).otherwise(_score(trees[1], f))
    scored = F.transform("more", lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"), score(c["f"]).alias("z")))
    cut = lambda k: F.get(F.array(*[F.lit(c if math.isfinite(c) else 1e9) for c in cuts]), k)
    picked = F.filter(scored, lambda c: (c["z"] >= cut(c["k"])) & ~F.exists("base", lambda b: _overlaps(b, c)))

    more = let(picked, _best) if any(map(math.isfinite, cuts)) else F.filter("base", lambda b: F.lit(False))
    found = rows.select("doc_id", "tag", "base", F.array_sort(F.concat("base", more)).alias("spans"))
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    rest = plain.where(~F.col("text").rlike("[0-9@]")).select("doc_id", "tag", none.alias("base"), none.alias("spans"))
    return found.unionByName(rest)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    got = find(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"))
    got = got.where(F.size("__spans") > 0).dropDuplicates(["__id", "__tag"])
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in FOUND])

    def step(t):
        def run(acc, s):
            return F.when(s["start"] >= acc["at"], F.struct(
                s["end"].alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["k"])).alias("out"))
            ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
        return run
    t = docs[text_col]
    cut = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step(t),
                      lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.char_length(t))))
    mine = docs[id_col].eqNullSafe(got["__id"]) & (F.xxhash64(F.coalesce(t, F.lit(""))) == got["__tag"])
    out = docs.join(got, mine, "left")
    return out.select(*[F.when(F.size("__spans") > 0, cut).otherwise(t).alias(c) if c == text_col else docs[c] for c in docs.columns])


def _joined(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in FOUND])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
