"""Operators 11 to 13 against brute force, on odd input and on the given tables."""

import hashlib
import zlib
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import embeddings, filter_audit, turn_trie
from lodestar.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def _twin(spark, name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLE[name])
    cols = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf).select(cols)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["op12_conversation_trie", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, name):
    _twin(spark, name)


# ---------------------------------------------------------------- embeddings

def _cosines(rows, threshold=0.98):
    """(vec_id, n_links, component_id) of each row by comparing all pairs."""
    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    link = defaultdict(set)
    for i in range(n):
        for j in range(i):
            (_, u, a), (_, v, b) = rows[i], rows[j]
            if good(u, a) and good(v, b) and a == b and len(u) == len(v):
                u, v = np.array(u, float), np.array(v, float)
                u, v = u / np.abs(u).max(), v / np.abs(v).max()
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                    link[i].add(j), link[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(link[i]), min(ids) if ids else None))
    return out


def _vectors():
    r = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(30):
            v = r.standard_normal(16)
            for _ in range(int(r.integers(1, 5))):                       # a group within and about the threshold
                rows.append((n, (v + r.standard_normal(16) * r.choice([0.0, 0.05, 0.2])).astype(np.float32).tolist(), label))
                n += 1
    copy = rows[0][1]
    rows += [(n + i, copy, 0) for i in range(3000)]                      # a hot group of equal vectors
    chain = [[float(np.cos(x)), float(np.sin(x)), 0.0] for x in np.arange(40) * 0.19]
    rows += [(n + 3000 + i, v, 7) for i, v in enumerate(chain)]          # linked one by one only
    rows += [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 16, 0), (5003, [1.0, None] * 8, 0), (5004, [float("nan")] * 16, 0),
             (5005, [float("inf")] * 16, 0), (5006, copy[:8], 0), (5007, [-x for x in copy], 0), (5008, copy, None),
             (None, copy, 1), (None, [1.0, 2.0], 3), (5009, [1e30, 1e30], 4), (5010, [3e38, 3e38], 4), (5011, [-0.0, 1.0], 5),
             (5012, [0.0, 2.0], 5), (5013, copy, 1), (5013, copy, 1), (5014, [1e-40, 1e-40], 4)]
    return rows


@pytest.mark.parametrize("block", [1024, 64])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "BUCKET", 16)
    rows = _vectors()
    hot = [x for x in rows if x[1] == rows[0][1] and x[2] == 0]
    cold = [x for x in rows if x not in hot[4:]]
    df = spark.createDataFrame([(*x, "other", 1) for x in rows], "vec_id bigint, embedding array<float>, label int, node string, weight int").repartition(5)
    got = [tuple(x) for x in embeddings.near_duplicates(df, recall=1 - 1e-9).collect()]
    assert len(got) == len(rows) and {c for c, *_ in got} == {c for c, *_ in rows}
    want = _cosines(cold)
    extra = len(rows) - len(cold)                        # further rows equal to the hot ones: each adds one link to what links with them
    near_hot = {x[0] for x, w in zip(cold, want, strict=True) if w[2] == 0 and x[0] != 0 and x not in hot and x[2] == 0
                and np.dot(x[1], hot[0][1]) / np.linalg.norm(x[1]) / np.linalg.norm(hot[0][1]) >= 0.98}
    hot_ids = {x[0] for x in hot}
    want = [(i, k + extra * (i in hot_ids or i in near_hot), c) for i, k, c in want] + [
        (x[0], next(w[1] for w in want if w[0] == hot[0][0]) + extra, 0) for x in hot[4:]]
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted([x[:3] for x in got], key=key) == sorted(want, key=key)
    assert all(kept == (i == c) for i, _, c, kept in got)


def test_planned_tables_meet_pairs_at_the_threshold():
    for rows in (10, 10_000, 10_000_000, 10**11):
        bits, tables = embeddings.plan(rows)
        meet = (1 - np.arccos(0.98) / np.pi) ** bits
        assert 1 - (1 - meet) ** tables >= 0.99 and rows / 2**bits <= embeddings.BUCKET * 1.01


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).collect() == []


# --------------------------------------------------------------------- trie

def _trie(rows):
    """The nodes by walking every rebuilt conversation through a dictionary."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    seqs = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        seqs[c] = own.get(base, [])[:h] + x[h:]
    members, parent = defaultdict(list), {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _turns():
    r = np.random.default_rng(3)
    say = lambda: ("user" if r.random() < 0.5 else "assistant", "t%d é\U0001F600" % r.integers(0, 3))
    rows = []
    for c in [*range(0, 130), *range(300, 340), -7, -100, 205]:
        rows += [(c, t, *say()) for t in range(int(r.integers(1, 9)))]
    long = [(t, *say()) for t in range(700)]
    rows += [(400, *x) for x in long] + [(401, *x) for x in long] + [(402, *x) for x in long[:650]] + [(403, *x) for x in long[:64]]     # several bands
    rows += [(500 + c, t, "user", "same") for c in range(600) for t in range(3)]                # a hot group of equal conversations
    rows += [(7, None, None, None), (7, None, "user", ""), (8, 2, "user", "t1"), (8, 2, "user", "t1"), (8, 2, "assistant", "t1"),
             (None, 1, "user", "x"), (None, None, None, None), (2000, 0, "user", "only"), (2001, None, None, "x" * 100_000)]
    return rows


@pytest.mark.parametrize("shard, piece, band", [(8192, 1 << 18, 64), (37, 50, 2), (5, 1 << 18, 3)])
def test_trie_equals_a_dictionary(spark, monkeypatch, shard, piece, band):
    for name, value in (("SHARD", shard), ("PIECE", piece), ("BAND", band)):
        monkeypatch.setattr(turn_trie, name, value)
    rows = _turns()
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "conv_id bigint, turn bigint, role string, text string, depth int, n string").repartition(4)
    if shard < 100:      # small shards: nodes across many of them; small range partitions for the positions as well
        rows = [x for x in rows if x[0] is None or x[0] not in range(560, 1100)]
        df = df.where("conv_id is null or conv_id not between 560 and 1099")
    key = lambda row: tuple((x is None, x) for x in row)
    got = [tuple(x) for x in turn_trie.trie(df).collect()]
    assert sorted(got, key=key) == sorted(_trie(rows), key=key)


def test_trie_of_nothing(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert turn_trie.trie(spark.createDataFrame([], schema)).collect() == []
    assert turn_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).collect() == []
    h = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)           # all its turns fall away: no first conversation
    got = turn_trie.trie(spark.createDataFrame([(h, 1, "user", "x")], schema)).collect()
    assert [tuple(x) for x in got] == [(h, 0, None, 1, 0, 1, 0, hashlib.sha256(str(h).encode()).hexdigest())]


# -------------------------------------------------------------------- audit

def _audit(rows, labels):
    split = lambda t: [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    kind = defaultdict(lambda: [False, False])
    for i, q, x in labels:
        if i is not None:
            kind[i][0] |= q == 1
            kind[i][1] |= x == 1
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = split(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and t in least and least[t] < i}
        parts[lang or ""].append((frozenset(k for k, v in fails.items() if v), *(kind[i] if i is not None else (False, False))))
    out = []
    for part, docs in parts.items():
        shapley, mine = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                mine.append((part, "".join(order), step, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone),
                             sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in mine]
    return out


def test_audit_equals_filtering_in_every_order(spark):
    r = np.random.default_rng(5)
    texts = [None, "", "  \n", "one", "ABC def", "a#b", " ".join("w%d" % x for x in range(120)), " ".join(["a", "b"] * 80),
             " ".join("W%d" % x for x in range(120)), " ".join("W%d" % x for x in range(99)) + " |", "x y z " * 20_000, "É\U0001F600 ÀB c"]
    rows = [(int(r.integers(0, 60)) if r.random() < 0.9 else None, texts[r.integers(0, len(texts))], [None, "", "en", "de"][r.integers(0, 4)]) for _ in range(300)]
    rows += [(1000, texts[6], "en")] * 50
    labels = [(int(i), int(r.integers(0, 2)), [None, 0, 1][r.integers(0, 3)]) for i in r.integers(0, 60, 50)] + [(None, 1, 1), (9999, 1, 1), (1000, None, 1)]
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id bigint, text string, lang string, part int, mask string").repartition(4)
    tagged = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, good string")
    got = [tuple(x) for x in filter_audit.audit(filter_audit.cells(filter_audit.failures(docs), tagged), "ABCDE").collect()]
    assert sorted(got) == sorted(_audit(rows, labels))


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(filter_audit.failures(docs), labels), "ABCDE").collect() == []


@pytest.mark.parametrize("k", [1, 3, 6])
def test_gray_walk_of_any_number_of_filters(k):
    r = np.random.default_rng(k)
    mask, n = np.arange(1 << k), r.integers(0, 50, (1 << k, 3))
    states = filter_audit.gray_states(mask, n, k)
    for active in range(1 << k):
        assert (states[active] == n[mask & active == 0].sum(axis=0)).all()


def test_vectors_of_sliced_and_null_columns():
    col = pa.array([[1.0, 2.0], None, [], [3.0, None], [0.0, 0.0], [5.0, 6.0], [7.0]], pa.list_(pa.float32())).slice(1)
    got = {r: x.tolist() for rows, m in embeddings.vectors(col) for r, x in zip(rows.tolist(), m, strict=True)}
    assert got == {4: [5.0, 6.0], 5: [7.0]}
