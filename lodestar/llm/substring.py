"""Substring deduplication with prefix-partitioned suffix trees.

The repeats looked for are windows of WINDOW words that start in two documents.
A suffix is a word position; its path is the hashes of BLOCKS consecutive
blocks of its first WINDOW words, so a node at depth BLOCKS of the tree over
these paths is one window, and its leaves are the places where it starts.

1. Anchors thin the suffixes without loss: of the STEP-word runs inside a window
   the one with the smallest hash is its anchor, and equal windows have equal
   anchors.  A suffix whose anchor occurs in one text only has no repeat.
2. The other suffixes are split by the first block of their path; a group
   beyond GROUP suffixes is split by the next block as well, and so on, so every
   group fits in memory.  A group split down to the whole path is one node, and
   is folded by a partial aggregation instead (a passage in very many documents).
3. Each task takes whole groups, sorts their paths (the leaves in tree order)
   and walks them with one node open at a time: runs of equal paths are the
   deep nodes, and a leaf whose document is not the node's smallest is a repeat.
4. The words under the repeats are removed, document by document.

Copies with the same word sequence are settled first: only the one with the
smallest id enters the tree, the others lose every word of a text of at least
WINDOW words.

Results for odd input: null text has no words; a null id is not smaller than
any and has none smaller, so its text stays and removes nothing; rows that share
an id do not affect each other; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import wordhash as wh
from lodestar.llm.base import near, query, read, small_batches, store, trimmed

WINDOW, BLOCKS = 50, 5
STEP = 25                # words of an anchor
GROUP = 200_000          # suffixes of one subtree


def windows_anchor(h: np.ndarray) -> np.ndarray:
    """Per window start, the smallest hash of the STEP-word runs inside the window."""
    runs = wh.long_window_hashes(h, STEP, 1)
    span = WINDOW - STEP + 1
    n = len(runs) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # running minimum of a fixed span: suffix minima of blocks of that span meet prefix minima
    pad = (-len(runs)) % span
    x = np.concatenate([runs, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(x, axis=1).ravel()
    return np.minimum(ahead[:n], behind[span - 1:span - 1 + n])


def paths(h: np.ndarray) -> np.ndarray:
    """(windows, BLOCKS) block hashes."""
    b = WINDOW // BLOCKS
    runs = wh.long_window_hashes(h, b, 2)
    n = len(h) - WINDOW + 1
    return np.stack([runs[k * b:k * b + n] for k in range(BLOCKS)], axis=1)


def _rows(column):
    """Per row: its bytes, word starts and ends in them, and word hashes."""
    for _, data, offsets in wh.chunks(column):
        starts, ends, first = wh.spans(data, offsets)
        h = wh.word_hashes(data, starts, ends)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield data, starts[a:b], ends[a:b], h[a:b]


def _joined(data, starts, ends) -> bytes:
    """The words joined by one space."""
    raw = data.tobytes() if len(starts) else b""
    if len(starts):
        raw = raw[starts[0]:ends[-1]]
    return b" ".join(raw.split())


SCAN = "doc_id bigint, n_words bigint, sha string, seq binary, anchors array<bigint>"


def _scan(batches):
    for batch in batches:
        n, sha, seq, anchors = [], [], [], []
        for data, starts, ends, h in _rows(batch.column(1)):
            n.append(len(h))
            words = _joined(data, starts, ends)
            sha.append(hashlib.sha256(words).hexdigest())
            seq.append(hashlib.md5(words).digest())
            anchors.append(np.unique(windows_anchor(h)).view(np.int64) if len(h) >= WINDOW else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                                          pa.array(seq, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))],
                                         names=["doc_id", "n_words", "sha", "seq", "anchors"])


def _packed(batches):
    """Rows (doc_id, text) to (doc_id, seq, packed)."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        seq = [hashlib.md5(_joined(data, starts, ends)).digest() for data, starts, ends, _ in _rows(batch.column(1))]
        packed = [z.compress((x or "").encode()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "seq", "packed"])


def _texts(packed) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(x).decode() for x in packed.to_pylist()], pa.large_string())


PATH = [f"b{k}" for k in range(BLOCKS)]
SUFFIX = "doc_id bigint, tid bigint, pos int, " + ", ".join(f"{b} bigint" for b in PATH)


def _suffixes(batches):
    """Rows (doc_id, packed, seq, anchors that occur elsewhere too): the paths
    of the suffixes with such an anchor."""
    for batch in batches:
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("tid").to_pylist(), batch.column("seq").to_pylist(),
                   batch.column("shared").to_pylist(), _rows(_texts(batch.column("packed"))), strict=True)
        for doc, tid, seq, shared, (data, starts, ends, h) in rows:
            if len(h) < WINDOW or hashlib.md5(_joined(data, starts, ends)).digest() != seq:
                continue
            pos = np.flatnonzero(np.isin(windows_anchor(h), np.array(shared, np.int64).view(np.uint64)))
            if len(pos):
                p = paths(h)[pos].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), doc)), pa.array(np.full(len(pos), tid)), pa.array(pos.astype(np.int32)),
                                                  *[pa.array(p[:, k].copy()) for k in range(BLOCKS)]], names=["doc_id", "tid", "pos", *PATH])


def _removed(batches):
    """Rows (doc_id, seq, n_words, sha, packed, positions) to the result columns."""
    for batch in batches:
        n, gone, sha = [], [], []
        rows = zip(batch.column("hits").to_pylist(), _rows(_texts(batch.column("packed"))), strict=True)
        for hits, (data, starts, ends, h) in rows:
            edge = np.zeros(len(h) + 1, np.int64)
            at = np.unique(np.array(hits, np.int64))
            edge[at] += 1
            edge[at + WINDOW] -= 1
            covered = np.cumsum(edge[:-1]) > 0
            words = _joined(data, starts, ends).split()
            n.append(len(h)), gone.append(int(covered.sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, c in zip(words, covered, strict=True) if not c)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                          pa.array(sha, pa.string())], names=["doc_id", "seq", "n_words", "n_removed", "kept_sha256"])


def repeats(suffixes: DataFrame) -> DataFrame:
    """(doc_id, tid, pos) of the suffixes whose window starts in a smaller document."""
    open_, done, level = suffixes, [], 1
    while True:
        key = PATH[:level]
        sizes = store(open_.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
                      .where("d0 < d1"), "suffix-groups")     # a group of one document holds no repeat
        if level == BLOCKS:
            done.append(open_.join(sizes, key).where("doc_id > d0").select("doc_id", "tid", "pos"))
            break
        fits = open_.join(sizes.where(F.col("size") <= GROUP).select(*key), key)
        parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        done.append(fits.repartition(parts, *key).sortWithinPartitions(*PATH, "doc_id").select(*PATH, "doc_id", "tid", "pos")
                    .mapInArrow(trimmed(_runs), "doc_id bigint, tid bigint, pos int"))
        big = sizes.where(F.col("size") > GROUP)
        if big.isEmpty():
            break
        open_, level = store(open_.join(big.select(*key), key), "suffix-open"), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _runs(batches):
    """Leaves in tree order, (path, doc_id) sorted: within a deep node every
    leaf after those of the smallest document.  One node is open at a time."""
    last, smallest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(b).to_numpy() for b in PATH]
        doc = batch.column("doc_id").to_numpy()
        new = np.ones(len(doc), bool)
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(int(c[0]) for c in cols)
        low = doc[new].copy()
        if first == last:
            low[0] = smallest
        node = np.cumsum(new) - 1
        hit = doc != low[node]
        last, smallest = tuple(int(c[-1]) for c in cols), low[-1]
        yield batch.select(["doc_id", "tid", "pos"]).filter(pa.array(hit))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = store(docs.mapInArrow(trimmed(_scan), SCAN), "suffix-scan")
    firsts = scanned.where("doc_id is not null and anchors is not null").groupBy("seq").agg(F.min("doc_id").alias("first"))
    # one text per word sequence, and the anchors that at least two of these texts have
    mine = scanned.where("anchors is not null").join(firsts, "seq").where("doc_id = first").dropDuplicates(["doc_id", "seq"]).select("doc_id", "seq", "anchors")
    mine = store(mine, "suffix-texts")
    anchors = mine.select("doc_id", "seq", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("anchor")
    of_text = store(anchors.join(shared, "anchor").groupBy("doc_id", "seq").agg(F.collect_list("anchor").alias("shared")), "suffix-shared")

    wanted = near(store(of_text.select(F.col("doc_id").alias("__id")).distinct(), "suffix-ids"))
    texts = docs.join(wanted, F.col("doc_id") == F.col("__id"), "left_semi").mapInArrow(trimmed(_packed), "doc_id bigint, seq binary, packed binary")
    texts = store(texts.dropDuplicates(["doc_id", "seq"])
                  .join(of_text, ["doc_id", "seq"]).select("doc_id", F.xxhash64("seq").alias("tid"), "seq", "packed", "shared"), "suffix-packed")
    suffixes = store(texts.mapInArrow(trimmed(_suffixes), SUFFIX), "suffixes")
    hits = repeats(suffixes).groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("hits"))
    changed = texts.drop("shared").join(hits, ["doc_id", "tid"]).mapInArrow(trimmed(_removed), "doc_id bigint, seq binary, n_words bigint, n_removed bigint, kept_sha256 string")
    changed = store(changed, "suffix-changed").withColumnsRenamed({"n_words": "__n", "kept_sha256": "__sha"})

    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = scanned.drop("anchors").join(firsts, "seq", "left").join(changed, ["doc_id", "seq"], "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return out.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                      F.when(copy, none).otherwise(F.coalesce("__sha", "sha")).alias("kept_sha256"))


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
