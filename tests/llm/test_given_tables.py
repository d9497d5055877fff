"""Registered queries on the given tables, against what they must hold or a
plain recomputation."""

import re
from collections import defaultdict

import pytest

from lodestar.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_op1_drops_the_documents_labelled_bad(spark):
    kept = {r.doc_id: r.kept for r in QUERIES["op1_quality_rules"](spark, SF).collect()}
    by = defaultdict(list)
    for r in _table(spark, "labels"):
        by[r.quality].append(kept[r.doc_id])
    assert sum(by[0]) <= 0.05 * len(by[0]) and sum(by[1]) >= 0.94 * len(by[1])


def test_op5_targets_and_what_is_taken(spark):
    size, of = defaultdict(int), {}
    for r in _table(spark, "documents"):
        of[r.doc_id] = (r.source, len(WORD.findall(r.text or "")))
        size[r.source] += of[r.doc_id][1]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, free = {}, set(size)
    while free:                                         # stop what is above three times its size, share the excess again
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        stopped = {s for s in free if level * weight[s] > 3 * size[s]}
        if not stopped:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in stopped}
        free -= stopped
    taken, largest = defaultdict(int), defaultdict(int)
    got = QUERIES["op5_mixing"](spark, SF).collect()
    assert len(got) == len(of)
    for r in got:
        s, n = of[r.doc_id]
        assert (r.size, r.source_size) == (n, size[s]) and r.target == pytest.approx(target[s], rel=1e-9)
        assert r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in size)
    again = {r.doc_id: r.taken for r in QUERIES["op5_mixing"](spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_op2_adds_spans_on_the_given_tables(spark):
    """Beyond the base patterns: the tokens named as such, and nothing else."""
    text = {r.doc_id: r.text or "" for r in _table(spark, "documents")}
    added, named = [], 0
    for r in QUERIES["op2_pii"](spark, SF).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        base = r.n_email + r.n_ip + r.n_card + r.n_phone
        assert len(spans) >= base
        added += [text[r.doc_id][int(a) - 12:int(b)] for k, a, b in spans if k == "secret"]
        named += len(re.findall(r'token = "[0-9a-f]{40}"', text[r.doc_id]))
    assert named and len(added) >= 0.9 * named
    assert sum(bool(re.search(r"(token|secret|key|pass)", x)) for x in added) >= 0.95 * len(added)


def test_op3_on_documents_held_out(spark):
    lang = {r.doc_id: r.lang for r in _table(spark, "documents")}
    held = [(r.lang_pred, lang[r.doc_id], r.score) for r in QUERIES["op3_language_id"](spark, SF).collect() if r.held_out]
    assert sum(a == b for a, b, _ in held if a != "und") >= 0.98 * len(held) and all(0 <= s <= 1 for *_, s in held)
