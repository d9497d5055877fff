"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit (log odds of hashed
byte n-grams between the languages with and without the bit) predicts it.  The
classifiers come from counts over all training documents.  Decoding is loss
weighted: a bit counts for a language by how often the classifier was right on
that language's training documents, and the codeword with the smallest weighted
loss wins.  A text whose two nearest codewords are about as near is flagged
ambiguous.

Results for odd input: null text and text without a letter is ``und`` with score
0; documents with null language or null id are not learned from; with no
training document every text is ``und``; rows that share an id get a row each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import wordhash as wh
from lodestar.llm.base import query, read, small_batches, trimmed

FEATURES = 1 << 14
ROWS = 64                 # texts of one feature matrix
SMOOTH = 0.5
AMBIGUOUS = 0.05          # score below which the nearest codeword is not clearly the nearest
REJECT = 0.01             # score below which the pipeline drops a text as undecided
EXHAUSTIVE = 6            # up to so many languages every split of them is a bit
_CLASS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of +1 and -1: every split of the languages in two, or
    for many languages splits by a fixed hash."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1.0 if k == 0 or not s >> (k - 1) & 1 else -1.0 for s in splits] for k in range(n)])
    bits = 10 * int(np.ceil(np.log2(n)))
    h = wh.mix(np.arange(n * bits, dtype=np.uint64) + np.uint64(12345)).reshape(n, bits)
    return np.where(h >> np.uint64(63), 1.0, -1.0)


def features(column: pa.Array):
    """Per slice of rows: (first row, matrix of n-gram counts)."""
    for lo, data, offsets in wh.chunks(column):
        x = _CLASS[data]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        grams = [x]
        for k in (2, 3):
            g = (grams[-1][:-1] * np.uint32(0x9E3779B1) + x[k - 1:] * np.uint32(0x85EBCA6B)) if len(x) >= k else x[:0]
            grams.append(g ^ (g >> np.uint32(15)))
        for a in range(0, len(offsets) - 1, ROWS):
            b = min(a + ROWS, len(offsets) - 1)
            i, j = offsets[a], offsets[b]
            count = np.zeros((b - a) * FEATURES, np.int64)
            for k, g in enumerate(grams, 1):
                e = max(i, j - k + 1)
                r = row[i:e]
                inside = row[i + k - 1:e + k - 1] == r                # not across two texts
                at = (r[inside] - a) * FEATURES + ((g[i:e][inside] + np.uint32(k * 977)) % np.uint32(FEATURES)).astype(np.int64)
                count += np.bincount(at, minlength=len(count))
            yield lo + a, count.reshape(b - a, FEATURES)


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for lo, x in features(batch.column(0)):
            here = langs[lo:lo + len(x)]
            for lang in set(here):
                total.setdefault(lang, np.zeros(FEATURES, np.int64))
                total[lang] += x[here == lang].sum(axis=0)
    for lang, c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])],
                                         names=["lang", "feature", "n"])


class Model:
    """langs, code (languages x bits), weights (features x bits), trust (languages x bits)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        p = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
        one, two = self.code > 0, self.code < 0
        with np.errstate(invalid="ignore", divide="ignore"):
            yes = (one.T @ p) / one.sum(axis=0)[:, None]
            no = (two.T @ p) / two.sum(axis=0)[:, None]
            self.weights = np.where(two.any(axis=0)[:, None], np.log(yes) - np.log(no), 1.0).T.astype(np.float32)
        self.trust = np.ones_like(self.code) / max(1, self.code.shape[1])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Mean log odds per n-gram, times a factor that grows slowly with their number."""
        n = np.maximum(x.sum(axis=1, keepdims=True), 1)
        return (x.astype(np.float32) @ self.weights) / n * np.log1p(n)

    def decode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score in 0..1)."""
        loss = (np.logaddexp(0, -self.code[None] * m[:, None, :]) * self.trust[None]).sum(axis=2)
        if loss.shape[1] == 1:
            return np.zeros(len(m), int), np.ones(len(m))
        near = np.sort(loss, axis=1)
        return loss.argmin(axis=1), 1 - np.exp(near[:, 0] - near[:, 1])


def _accuracy(model):
    def run(batches):
        right, total = np.zeros(model.code.shape), np.zeros(model.code.shape)
        where = {x: i for i, x in enumerate(model.langs)}
        for batch in batches:
            index = np.array([where[x] for x in batch.column(1).to_pylist()], int)
            for lo, x in features(batch.column(0)):
                k = index[lo:lo + len(x)]
                hit = (model.margins(x) > 0) == (model.code[k] > 0)
                np.add.at(right, k, hit)
                np.add.at(total, k, 1)
        k, j = np.indices(right.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel().astype(np.int64)) for v in (k, j, right, total)], names=["k", "j", "hit", "total"])
    return run


LETTER = r"[^\W\d_]"


def _predict(model):
    def run(batches):
        letter = re.compile(LETTER)
        for batch in batches:
            n = batch.num_rows
            best, score = np.zeros(n, int), np.zeros(n)
            if model is not None:
                for lo, x in features(batch.column(2)):
                    best[lo:lo + len(x)], score[lo:lo + len(x)] = model.decode(model.margins(x))
            known = [model is not None and t is not None and bool(letter.search(t)) for t in batch.column(2).to_pylist()]
            lang = [model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score),
                                              pa.array((score < AMBIGUOUS) & np.array(known, bool))],
                                             names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])
    return run


def train(rows: DataFrame) -> Model | None:
    """``rows`` (text, lang).  What reaches the driver: languages x FEATURES counts, languages x bits accuracies."""
    small_batches(rows.sparkSession)
    got = rows.mapInArrow(trimmed(_counts), "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return None
    counts = np.zeros((len(langs), FEATURES))
    for r in got:
        counts[langs.index(r["lang"]), r["feature"]] = r["n"]
    model = Model(langs, counts)
    acc = np.full(model.code.shape, 0.5)
    got = (rows.where(F.col("lang").isin(langs)).mapInArrow(trimmed(_accuracy(model)), "k bigint, j bigint, hit bigint, total bigint")
           .groupBy("k", "j").agg(F.sum("hit").alias("hit"), F.sum("total").alias("total")).collect())
    for r in got:
        if r["total"]:
            acc[r["k"], r["j"]] = r["hit"] / r["total"]
    trust = np.maximum(acc, 1e-3)
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from the rows with crc32(id) mod 4 other than 2."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.where("not held_out and lang is not null and doc_id is not null and text is not null").select("text", "lang"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return rows.select("doc_id", "held_out", "text").mapInArrow(trimmed(_predict(model)), schema)


def _accept(model, at):
    def run(batches):
        letter = re.compile(LETTER)
        for batch in batches:
            texts = batch.column(at)
            keep = np.array([model is not None and t is not None and bool(letter.search(t)) for t in texts.to_pylist()], bool)
            if model is not None:
                for lo, x in features(texts):
                    _, score = model.decode(model.margins(x))
                    keep[lo:lo + len(x)] &= score >= REJECT
            yield batch.filter(pa.array(keep))
    return run


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows it rejects: no letter in the text, or two
    codewords equally near (score under REJECT)."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    known = docs.where(~held & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    model = train(known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    return docs.mapInArrow(trimmed(_accept(model, docs.columns.index(text_col))), docs.schema)


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
