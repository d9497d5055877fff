"""Packing by lexical retrieval.

Every document is tokenised once.  Its full windows are sequences of their own;
its tail is to be packed.  Tails are dealt to shards by a lexical signature
(two min-hashes of the text's token ids, so texts with common vocabulary meet;
a hash of the row splits even a signature that very many texts share).  In a
shard an inverted index over the texts' token ids with BM25 weights (document
frequencies and the mean length are those of the whole corpus; the vocabulary
bounds them) returns, for a seed, its unused neighbours, best first; they fill
the seed's window greedily (texts equal to one it holds only when no others are
left), the last one is cut and its rest stays unused.  A
window that a shard cannot fill goes on in the task's next shard; the one left
at a task's end is cut into sequences whose lengths are powers of two, which
need no padding.

Results for odd input: null or empty text has the single end id; rows that share
an id are packed each for itself; a null id is carried; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import base64
import sys
import zlib
from types import ModuleType

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import wordhash as wh
from lodestar.llm.base import query, read, small_batches, store, trimmed

WINDOW = 1024
CHUNK = 1 << 20        # bytes of text tokenised at a time
SHARD = 256            # tails of one index
END = 0                # id after each document
K1, B = 1.2, 0.75
TASK_TOKENS = 1 << 23  # tail tokens of one packing task
# bytes (C9 with what follows it) of characters other than a line break, ASCII from the space on and U+00C0 to U+024F: such texts go to the reference tokenizer
ODD = np.array([b < 0x20 and b != 0x0A or b == 0x7F or b == 0xC2 or b >= 0xCA for b in range(256)])


class Encoder:
    """ids of texts.  Both files hold one vocabulary; the ranks are the faster
    way for ordinary characters, anything else takes the tokenizer file."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str, chunk: int = CHUNK):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.width = np.zeros(max(table.values()) + 1, np.int64)           # bytes of each token
        self.width[list(table.values())] = [len(x) for x in table]
        self.full = Tokenizer.from_file(tokenizer)
        self.full.encode_special_tokens = True      # their strings in a text are ordinary text
        self.chunk = chunk
        self.kind = np.uint16 if self.full.get_vocab_size() <= 1 << 16 else np.uint32

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, ids of each).  Pieces of white
        space and a word after it are encoded as one text, as no token crosses
        from one to the next, and told apart by the bytes of the tokens; the
        others, or all if a token should cross, one by one."""
        white = (data[starts] == 32) | (data[starts] == 10)
        joined = white & (data[ends - 1] != 32) & (data[ends - 1] != 10)
        found, count = np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        if joined.any():
            size = (ends - starts)[joined]
            stop = np.cumsum(size)
            text = data[np.repeat(starts[joined] - stop + size, size) + np.arange(stop[-1])].tobytes().decode()
            found = np.array(self.fast.encode_ordinary(text), np.uint32)
            reached = np.cumsum(self.width[found])
            last = np.searchsorted(reached, stop)
            if (reached[np.minimum(last, len(reached) - 1)] == stop).all():
                count[joined] = np.diff(np.append(0, last + 1))
            else:
                joined[:], found = False, np.zeros(0, np.uint32)
        out = np.zeros(len(starts), object)
        alone = np.flatnonzero(~joined)
        if not len(alone):
            return found, count
        for k in alone:
            out[k] = np.array(self.fast.encode_ordinary(data[starts[k]:ends[k]].tobytes().decode()), np.uint32)
            count[k] = len(out[k])
        # one after another in the order of the pieces
        flat, first = np.zeros(count.sum(), np.uint32), np.cumsum(count) - count
        size = count[joined]
        flat[np.repeat(first[joined] - np.cumsum(size) + size, size) + np.arange(size.sum())] = found
        for k in alone:
            flat[first[k]:first[k] + count[k]] = out[k]
        return flat, count

    def batch(self, column: pa.Array):
        """ids of each row, with the end id.  No token reaches from a character
        into white space after it, so a text is the pieces (white space and the
        word after it) put together, and equal pieces of a chunk are encoded once."""
        for lo, data, offsets in wh.chunks(column, self.chunk):
            odd = ODD[data]
            odd[:-1] |= (data[:-1] == 0xC9) & (data[1:] > 0x8F)
            seen = np.append(0, np.cumsum(odd))
            plain = seen[offsets[1:]] == seen[offsets[:-1]]
            space = (data == 32) | (data == 10)
            start = np.zeros(len(data) + 1, bool)
            start[1:-1] = space[1:] & ~space[:-1]
            start[offsets] = True
            starts = np.flatnonzero(start[:-1])
            ends = np.append(starts[1:], len(data))
            kept = plain[np.searchsorted(offsets, starts, "right") - 1] if len(starts) else np.zeros(0, bool)
            starts, ends = starts[kept], ends[kept]
            _, at, inverse = np.unique(wh.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            flat, size = self.pieces(data, starts[at], ends[at])
            first = (np.cumsum(size) - size)[inverse]
            count = size[inverse]
            total = np.append(0, np.cumsum(count))
            ids = flat[np.repeat(first - total[:-1], count) + np.arange(total[-1])] if len(count) else flat
            cut = total[np.searchsorted(starts, offsets)]
            for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                x = ids[a:b] if plain[r] else self.ids(data[offsets[r]:offsets[r + 1]].tobytes().decode())
                yield np.append(x, END).astype(self.kind)


def worker_memory() -> dict:
    """What this worker process keeps between tasks.  It hangs on a module made
    here, as the tasks' code travels by value and brings its own globals."""
    return sys.modules.setdefault("_lodestar_worker", ModuleType("_lodestar_worker")).__dict__.setdefault("kept", {})


def encoder_of(*given) -> Encoder:
    """One for all tasks of a worker: its files are read once, until a task of a
    later step needs the memory."""
    kept = worker_memory()
    if given not in kept:
        kept.clear()
        kept[given] = Encoder(*given)
    return kept[given]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)


TOKENISED = ("doc_id bigint, n bigint, crcs array<bigint>, tail binary, tail_n bigint, terms binary, counts binary, "
             "top int, sig bigint, full array<binary>")


def _tokenise(paths, window, with_ids):
    def run(batches):
        for batch in batches:
            encoder = encoder_of(*paths)
            rows = {k: [] for k in ("n", "crcs", "tail", "tail_n", "terms", "counts", "top", "sig", "full")}
            for ids in encoder.batch(batch.column(1)):
                cut = len(ids) // window * window
                full = [ids[i:i + window] for i in range(0, cut, window)]
                terms, counts = np.unique(ids, return_counts=True)
                rows["n"].append(len(ids))
                rows["crcs"].append([crc(x) for x in full])
                rows["tail"].append(ids[cut:].astype("<u4" if ids.itemsize == 4 else "<u2").tobytes())
                rows["tail_n"].append(len(ids) - cut)
                rows["terms"].append(terms.astype("<i4").tobytes()), rows["counts"].append(counts.astype("<i4").tobytes())
                rows["top"].append(int(terms[-1]))
                rows["sig"].append(int(_hash(terms, 1).min()) << 24 | int(_hash(terms, 2).min()))
                rows["full"].append([x.astype("<u4").tobytes() for x in full] if with_ids else [])
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)]],
                                             names=["doc_id", *rows])
    return run


def _frequencies(size):
    def run(batches):
        worker_memory().clear()
        df = np.zeros(size, np.int64)
        for batch in batches:
            got = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            df += np.bincount(got, minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])
    return run


class Index:
    """BM25 inverted index over the texts of one shard."""

    def __init__(self, rows, idf, mean):
        self.n = len(rows)
        terms = np.concatenate([r["terms"] for r in rows])
        tf = np.concatenate([r["counts"] for r in rows]).astype(np.float32)
        length = np.repeat([r["n"] for r in rows], [len(r["terms"]) for r in rows]).astype(np.float32)
        doc = np.repeat(np.arange(self.n), [len(r["terms"]) for r in rows])
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        weight = idf[terms] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)))[order]
        self.doc, self.weight = doc[order], weight
        self.terms, first = np.unique(terms, return_index=True)
        self.first = np.append(first, len(terms))

    def neighbours(self, terms: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """Unused texts, best first; those without a common term last."""
        at = np.searchsorted(self.terms, terms)
        at = at[self.terms[np.minimum(at, len(self.terms) - 1)] == terms]
        size = self.first[at + 1] - self.first[at]
        post = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.doc[post], self.weight[post], self.n)
        free = np.flatnonzero(unused)
        return free[np.argsort(-score[free], kind="stable")]


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def _pack(idf, mean, window, with_ids):
    def run(batches):
        worker_memory().clear()
        part, made = TaskContext.get().partitionId(), 0
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}

        def sequence(pieces):                   # pieces: (row, start, ids)
            nonlocal made
            offset = 0
            for row, start, ids in pieces:
                for k, v in zip(out, (row["doc_id"], start, len(ids), crc(ids), row["n"], ((part << 33) + made) << 1 | 1, offset,
                                      ids.astype("<u4").tobytes() if with_ids else None), strict=True):
                    out[k].append(v)
                offset += len(ids)
            made += 1

        def flush():
            types = [pa.int64()] * 7 + [pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))
            for v in out.values():
                v.clear()
            return batch

        wide = [None, 0, None, None]            # open window: pieces, tokens, terms of its seed, its texts

        def take(row, room):
            ids = row["ids"][:room]
            wide[0].append((row, row["at"], ids))
            wide[1] += len(ids)
            wide[3].add(row["key"])
            row["ids"], row["at"] = row["ids"][room:], row["at"] + len(ids)
            return not len(row["ids"])

        def shard(rows):
            index, unused, seed = Index(rows, idf, mean), np.ones(len(rows), bool), 0
            while unused.any():
                if wide[0] is None:
                    while not unused[seed]:
                        seed += 1
                    wide[:] = [[], 0, rows[seed]["terms"], set()]
                    unused[seed] = not take(rows[seed], window)
                    if wide[1] < window and not unused.any():
                        break
                order = index.neighbours(wide[2], unused)
                for copies in (False, True):        # texts the window holds already come last
                    for i in order:
                        if wide[1] == window:
                            break
                        if unused[i] and (rows[i]["key"] in wide[3]) == copies:
                            unused[i] = not take(rows[i], window - wide[1])
                if wide[1] == window:
                    sequence(wide[0])
                    wide[0] = None

        rows = []
        for batch in batches:
            for r in batch.to_pylist():
                size = len(r["tail"]) // r["tail_n"]
                tail = r.pop("tail")
                r["key"] = (r["n"], zlib.crc32(tail))                  # copies have the same
                r["ids"], r["at"] = np.frombuffer(tail, "<u4" if size == 4 else "<u2"), r["n"] - r["tail_n"]
                r["terms"], r["counts"] = np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["counts"], "<i4")
                rows.append(r)
                if len(rows) == SHARD:
                    shard(rows)
                    rows = []
            yield flush()
        if rows:
            shard(rows)
        if wide[0]:                             # the last window: lengths that are powers of two
            left, pieces = wide[1], wide[0]
            while left:
                room, mine, rest = 1 << (left.bit_length() - 1), [], []
                for row, start, ids in pieces:
                    if room:
                        mine.append((row, start, ids[:room]))
                        start, ids, room = start + min(room, len(ids)), ids[room:], room - min(room, len(ids))
                    if len(ids):
                        rest.append((row, start, ids))
                sequence(mine)
                left, pieces = sum(len(x[2]) for x in rest), rest
        yield flush()
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False,
         tokenizer: str | None = None, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN,
         chunk: int = CHUNK) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids (little-endian unsigned
    32-bit).  A sequence is its pieces in order of offset.  ``chunk`` (bytes of
    text) bounds a worker's memory."""
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    paths = (tokenizer, ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern, chunk)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string"))
    done = store(texts.mapInArrow(trimmed(_tokenise(paths, window, with_ids)), TOKENISED), "pack-tokens")
    n, mean, tails, top = done.agg(F.count(F.lit(1)), F.avg("n"), F.sum("tail_n"), F.max("top")).first()
    if not n:
        return spark.createDataFrame([], PIECE)
    df = np.zeros(top + 1)
    for r in done.select("terms").mapInArrow(trimmed(_frequencies(top + 1)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]                  # at most one row per id of the vocabulary
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)

    windows = done.select("doc_id", "n", F.posexplode("crcs").alias("w", "ids_crc32"), "full").select(
        "doc_id", (F.col("w") * window).cast("bigint").alias("start"), F.lit(window).cast("bigint").alias("length"), "ids_crc32",
        F.col("n").alias("doc_tokens"), (F.monotonically_increasing_id() * 2).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), F.get("full", F.col("w")).alias("ids"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tails // TASK_TOKENS))
    spread = F.xxhash64("doc_id", "n", "tail")
    dealt = done.where("tail_n > 0").select("doc_id", "n", "tail", "tail_n", "terms", "counts", "sig", spread.alias("spread"))
    dealt = dealt.repartitionByRange(parts, "sig", "spread").sortWithinPartitions("sig", "spread", "doc_id")
    packed = dealt.select("doc_id", "n", "tail", "tail_n", "terms", "counts").mapInArrow(trimmed(_pack(idf, mean, window, with_ids)), PIECE)
    return windows.unionByName(packed)


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("ids")
