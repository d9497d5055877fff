"""Rows that share an id, personal data beyond the base patterns, and workers
that cannot import the package."""

import hashlib
import os
import re
import subprocess
import sys

import numpy as np
import pytest

from lodestar.llm import jaccard, packing, pii, substring

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _text(seed, n):
    return " ".join("w%d" % x for x in np.random.default_rng(seed).integers(0, 5000, n))


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    a, b = _text(1, 200), _text(2, 200)
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "x"), (2, b, "y"), (2, None, "z"), (None, a, "n")], "doc_id bigint, text string, tag string")
    kept = sorted((r.doc_id or 0, r.text or "", r.tag) for r in jaccard.one_per_component(docs).collect())
    assert kept == sorted([(1, a, "x"), (2, b, "y"), (2, "", "z"), (0, a, "n")])


def test_repeats_in_two_texts_of_one_id(spark):
    shared = _text(3, 60)
    one, short, long = f"{_text(4, 20)} {shared} {_text(5, 30)}", f"{shared} {_text(6, 5)}", f"{_text(7, 120)} {shared} {_text(8, 40)}"
    docs = spark.createDataFrame([(1, one), (2, short), (2, long), (3, _text(9, 70))], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs).collect())

    def row(i, text, gone):
        left = text.replace(shared, " ").split() if gone else text.split()
        return (i, len(text.split()), 60 if gone else 0, hashlib.sha256(" ".join(left).encode()).hexdigest())
    assert got == sorted([row(1, one, False), row(2, short, True), row(2, long, True), row(3, _text(9, 70), False)])


def test_redaction_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org now"), (1, "no data here at all"), (1, None), (2, "x@y.zz")], "doc_id bigint, text string")
    assert sorted(str(r.text) for r in pii.redact(docs).collect()) == ["None", "[EMAIL]", "mail [EMAIL] now", "no data here at all"]


def _personal():
    r = np.random.default_rng(5)
    hexes = lambda n: "".join("0123456789abcdef"[x] for x in r.integers(0, 16, n))
    rows, want = [], {}
    for i in range(400):
        words = _text(100 + i, 30).translate(str.maketrans("0123456789", "abcdefghij")).split()
        kind, spans = i % 8, []
        number = "(%03d) 555-%04d" % (r.integers(100, 999), r.integers(0, 9999))
        found = {0: ("phone", "+1 " + number), 1: ("secret", hexes(40)), 2: ("email", "a.%d@mail.example.com" % i), 3: ("phone", number),
                 4: ("secret", hexes(40))}.get(kind)
        if found:
            lead = 'token = "' if kind == 1 else ""
            words[12] = lead + found[1] + ('"' if kind == 1 else "")
        if kind == 5:
            words[5] = "%d %d" % (r.integers(10, 99), r.integers(10**7, 10**8))       # other numbers
        if kind == 6:
            words[5] = "file_%s_%d.txt" % ("x" * 12, i)
        text = " ".join(words)
        if found:
            at = text.index(found[1])
            spans.append((found[0], at, at + len(found[1])))
        rows.append((i, text))
        want[i] = spans
    return rows, want


def test_spans_beyond_the_base_patterns(spark):
    """Numbers without a plus and unnamed secrets of a known format are added;
    what else looks like them is not."""
    rows, want = _personal()
    got = {r.doc_id: [(pii.FOUND[s.k], s.start, s.end) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    right = {(i, *s) for i, x in want.items() for s in x}
    found = {(i, *s) for i, x in got.items() for s in x}
    added = {x for x in found if x[0] % 8 in (3, 4, 5, 6, 7)}
    assert {x for x in right if x[0] % 8 in (0, 2)} <= found                # the base patterns
    assert added and len(found & right) >= 0.95 * len(found)                 # precision
    assert len({x for x in right if x[1] == "secret"} & found) >= 0.9 * len({x for x in right if x[1] == "secret"})
    assert len(found & right) >= 0.9 * len(right)                            # recall


# fixed values: the base patterns of the contract
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and _luhn(d),
                    "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_op2_query_equals_the_base_patterns(spark, tmp_path):
    from lodestar.llm.base import QUERIES
    rows = _personal()[0] + [(1000, None), (1001, ""), (1002, "1.2.3.4.5.6 300.1.1.1 +1-(23) 4567.8901 é 4111 1111-1111 1111 x@y.z@w.v"), (1002, "+123")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op2_pii"](spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        b = _base(t or "")
        joined = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in b)
        want.append((i, *[sum(x[3] == kind for x in b) for kind in BASE], hashlib.sha256(joined.encode()).hexdigest(), set(joined.split(",")) - {""}))
    key = lambda x: x[:6]
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, set(r.spans.split(",")) - {""}) for r in got), key=key)
    assert [x[:6] for x in got] == [x[:6] for x in sorted(want, key=key)]
    assert all(w[6] <= g[6] for g, w in zip(got, sorted(want, key=key), strict=True))


def test_copies_of_a_text_do_not_share_a_window(spark):
    docs = spark.createDataFrame([(i, _text(i, 60)) for i in range(120)] + [(1000 + i, _text(7, 60)) for i in range(3)], "doc_id bigint, text string")
    seen = {}
    for r in packing.pack(docs.coalesce(1)).collect():
        if r.doc_id in (7, 1000, 1001, 1002):
            seen.setdefault(r.sequence_id, set()).add(r.doc_id)
    full = [s for s, x in seen.items() if len(x) > 1]
    assert len(full) <= 1                    # only where a window has no other text to take


SCRIPT = """
import sys, tempfile
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file:" + tempfile.mkdtemp()).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as e
q = e.queries()
for name in {names!r}:
    print("ran", name, q[name](spark, {sf!r}).count(), flush=True)
"""


def test_workers_need_not_import_the_package(tmp_path):
    """Every query with Python workers, on an executor whose workers start
    outside the repository and without PYTHONPATH."""
    names = ["op3_language_id", "op4_packing", "op7_arc_converter", "op8_substring_dedup", "op10_ngram_jaccard",
             "op11_embedding_near_dedup", "op12_conversation_trie", "op13_filter_audit"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    # the tokenizers' module is the box's own, not the repository's
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, names=names, sf="/root/testdata/sf0.001")], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=400)
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran")] == names, done.stdout[-2000:] + done.stderr[-3000:]


if __name__ == "__main__":
    pytest.main([__file__])
