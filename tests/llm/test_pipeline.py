"""The pipeline's stages, each on what the one before kept, against plain
recomputations, and the whole run on odd and on empty tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, tag string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
VOCAB = {"en": "the and of to in that was with for this".split(), "de": "der und die das nicht mit sich auf ein".split()}


def _text(seed, lang, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(VOCAB[lang]) + "abcdefghij"[r.integers(0, 10)] * int(r.integers(0, 3)) + "klmnop"[r.integers(0, 6)] for _ in range(n))


def _rows():
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append((i, _text(i, lang, 40 + i % 50), lang, f"s{i % 4}" if i % 7 else None, 0, "x", "y"))
    near = rows[49][1].split()
    near[30] = "changed"
    rows += [(200 + i, rows[3][1], "en", "s1", 0, "x", "y") for i in range(6)]                      # exact copies
    rows += [(300, " ".join(near), "en", "s2", 0, "x", "y"), (300, _text(999, "en", 60), "en", "s2", 0, "x", "y")]
    rows += [(400, None, "en", "s0", 0, "x", "y"), (401, "", "en", "s0", 0, "x", "y"), (402, "12 34 !?", "en", "s0", 0, None, None),
             (403, "word " * 30_000, "en", "s3", 0, "x", "y"), (None, _text(77, "de", 50), None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def _shingles(t):
    w = [x.lower() for x in WORD.findall(t or "")]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_each_stage_on_what_the_one_before_kept(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            kept.append([tuple(r) for r in docs.collect()])
        else:
            pieces = out.collect()
    language, exact, near, mixed = ([(r[0], r[1], r[3]) for r in rows] for rows in kept)
    given = [(r[0], r[1], r[3]) for r in _rows()]
    # language: what has a letter stays
    assert Counter(language) == Counter(r for r in given if re.search(r"[^\W\d_]", r[1] or ""))
    # exact: of equal texts the largest id
    largest = defaultdict(list)
    for r in language:
        largest[r[1]].append(r)
    assert Counter(exact) == Counter(max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in largest.values())
    # near: rows linked with a smaller id go
    sets = [_shingles(r[1]) for r in exact]
    link = [[j for j in range(len(exact)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(exact))]
    want = []
    for i, r in enumerate(exact):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        ids = [exact[j][0] for j in seen if exact[j][0] is not None]
        if r[0] is None or r[0] == min(ids):
            want.append(r)
    assert Counter(near) == Counter(want) and len(near) < len(exact)
    # mixing: only rows there were, none more than three times
    copies = Counter(mixed)
    assert set(copies) <= set(near) and max(copies.values()) <= 3
    # packing: every id of every row in one piece
    of = defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
    assert Counter(r[0] for r in mixed).keys() == of.keys()
    for i, ps in of.items():
        rows = sum(r[0] == i for r in mixed)
        assert sum(p.length for p in ps) == sum(p.doc_tokens for p in ps if p.start == 0) and sum(p.start == 0 for p in ps) == rows
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_and_an_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    empty = corpus_pipeline.run(spark, str(tmp_path))
    assert empty.collect() == [] and {"doc_id", "sequence_id"} <= set(empty.columns)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == [], name


def test_exact_stage_on_a_frame_that_is_no_whole_scan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 100 or doc_id > 203")
    got = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, folder).collect()}
    assert not got & set(range(100, 204)) and 205 in got
