"""Embedding near-duplicates: signs of random hyperplanes in several tables,
exact cosines, connected components.

Equal vectors of a label are one node with a weight.  Each table cuts the space
with ``bits`` random hyperplanes through the origin; the signs are the node's
bucket there, and two vectors at an angle a share it with probability
(1 - a / pi) ** bits.  Bits follow from the rows of the largest label (a bucket
of unlike vectors holds about BUCKET of them at every size), tables from RECALL,
the chance that a pair exactly at the threshold meets at least once.  Buckets
are dealt in blocks to tiles of at most some 2 * BLOCK nodes, where all cosines
are computed in double precision; no pair leaves a tile, only per node the
weight of its new links and the smallest node it reaches there.  A pair that
shares the bucket of an earlier table is counted there alone.  The edges to the
smallest nodes make components.

Results for odd input: a vector that is null, empty or zero, holds null or
non-finite components or has a null label has no links and is its own component;
vectors of unlike length have no cosine and never link; rows that share an id
keep a row each and link like any others; a null id counts as a vector,
a component's id is the smallest non-null id in it (null if it has none), and
``kept`` is whether both ids are the same or both null; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.base import lookup, query, read, small_batches, store
from lodestar.llm.jaccard import components

THRESHOLD = 0.98
RECALL = 0.995           # of pairs exactly at the threshold; nearer ones meet more often
BUCKET = 256             # unlike vectors of a label in one bucket, about
BLOCK = 1024             # nodes of a bucket in one side of a tile, about
SEED = 20_011


def plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for a label of so many rows."""
    bits = min(62, max(1, math.ceil(math.log2(max(rows, 2) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if meet >= recall else math.ceil(math.log1p(-recall) / math.log1p(-meet))


def vectors(column: pa.Array):
    """(rows, matrix) by length: the double-precision vectors that are neither
    null, empty nor zero and wholly finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)      # a null component is NaN
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        x = values[offsets[rows][:, None] + np.arange(d)] + 0.0                   # -0.0 is 0.0
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        yield rows[good], x[good]


def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _sign(bits: int, tables: int):
    place = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            label = batch.column(2).to_pylist()
            key, signs, dim, vec = [None] * n, [None] * n, [None] * n, [None] * n
            for rows, x in vectors(batch.column(3)):
                d = x.shape[1]
                if d not in planes:
                    planes[d] = hyperplanes(d, bits, tables)
                small = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])     # largest component near 1: no overflow
                side = ((small @ planes[d]) > 0).reshape(-1, tables, bits)
                code = (side * place).sum(axis=2)
                for k, r in enumerate(rows.tolist()):
                    if label[r] is not None:
                        key[r] = hashlib.blake2b(f"{label[r]!r}:{d}:".encode() + x[k].tobytes(), digest_size=16).hexdigest()
                        signs[r], dim[r], vec[r] = code[k], d, small[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(key, pa.string()), pa.array(dim, pa.int32()),
                 pa.array(signs, pa.list_(pa.int64())), pa.array(vec, pa.binary())],
                names=["row", "vec_id", "label", "key", "dim", "signs", "vec"])
    return run


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` have at least that cosine."""
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * np.sqrt(np.einsum("ij,ij->i", y, y))[None, :]
    return (x @ y.T) / size >= threshold


def _reach(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node reachable inside the tile, for either side."""
    most = np.iinfo(np.int64).max
    while True:
        to_a = np.minimum(a, np.where(hit, b[None, :], most).min(axis=1, initial=most))
        to_b = np.minimum(b, np.where(hit, to_a[:, None], most).min(axis=0, initial=most))
        if (to_a == a).all() and (to_b == b).all():
            return a, b
        a, b = to_a, to_b


TILE = "node bigint, links bigint, root bigint"


def _tile(threshold: float):
    """A tile's rows (side, node, weight, signs, vec) to (node, links, root):
    the weight of the links first met here, the smallest node they reach."""
    def run(key, table):
        t, same = key[2].as_py(), key[4].as_py() == key[5].as_py()
        side, node, weight = (table.column(c).to_numpy() for c in ("side", "node", "weight"))
        signs = np.array(table.column("signs").to_pylist(), np.int64).reshape(len(side), -1)
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(len(side), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        hit = linked(x[a], x[b], threshold)
        if same:
            hit = np.triu(hit, 1)
            hit |= hit.T
        for e in range(t):
            hit &= signs[a, e][:, None] != signs[b, e][None, :]
        ra, rb = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        hit, a, b = hit[np.ix_(ra, rb)], a[ra], b[rb]
        root_a, root_b = _reach(hit, node[a], node[b])
        parts = [(node[a], hit @ weight[b], root_a)]
        if not same:
            parts.append((node[b], hit.T @ weight[a], root_b))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], names=["node", "links", "root"])
    return run


def near_duplicates(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vecs``: vec_id, n_links, component_id, kept."""
    spark = vecs.sparkSession
    small_batches(spark)
    vecs = vecs.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    rows = vecs.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(rows, threshold, recall)
    kind = vecs.schema["label"].dataType.simpleString()
    signed = store(vecs.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vec").mapInArrow(
        _sign(bits, tables), f"row bigint, vec_id bigint, label {kind}, key string, dim int, signs array<bigint>, vec binary"), "embeddings-signed")
    nodes = store(signed.where("key is not null").groupBy("key").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")), "embeddings-nodes")
    full = signed.select(F.col("row").alias("node"), "label", "dim", "signs", "vec").join(nodes.select("node", "weight"), "node")

    # nodes of buckets with company, each in the tiles of its block with every block
    place = ["label", "dim", "t", "sign"]
    members = full.select("node", "label", "dim", F.posexplode("signs").alias("t", "sign"))
    crowds = members.groupBy(place).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    own, blocks = F.col("own"), F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = (members.join(crowds, place).withColumn("own", F.pmod(F.xxhash64("node", "t"), blocks).cast("int"))
             .withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1))))
    dealt = dealt.select("node", *place, F.least(own, "j").alias("i"), F.greatest(own, "j").alias("j"), (own > F.col("j")).cast("int").alias("side"))
    tiles = dealt.join(full.select("node", "weight", "signs", "vec"), "node")
    met = store(tiles.groupBy(*place, "i", "j").applyInArrow(_tile(threshold), TILE), "embeddings-met")

    labels = components(met.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("label", "component")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(links, "node", "left").join(labels, "node", "left").select(
        "key", "node", "weight", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"))
    named = store(named, "embeddings-named")
    groups = store(named.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("least").alias("component_id")), "embeddings-components")
    named = lookup(named, groups, "component", "size", nodes.count(), F.col("node")).select("key", "weight", "n_links", "component_id")
    good = lookup(signed.where("key is not null").select("row", "vec_id", "key"), store(named, "embeddings-ids"), "key", "weight",
                  signed.count(), F.col("row")).select("vec_id", "n_links", "component_id")
    bad = signed.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op11_embedding_near_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
