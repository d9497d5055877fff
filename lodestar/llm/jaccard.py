"""Exact n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A text's set holds the hashes of its distinct 5-word shingles.  Texts with
equal sets are one node.  Two nodes with Jaccard >= 0.8 share a hash among the
smallest fifth of each set (prefix principle), so nodes meet in lists, one per
such hash.  A list is cut into size bands (sizes within a factor 1.25): in a
short list all compatible nodes meet, in a long one each meets the band's hub,
the node with the largest share of its hashes in long lists (of a group of
near copies that is the one most like all the others), and hubs meet the hubs
of the next band.  Pairs that meet are dropped when the bit count of their hashed parity
bitmaps bounds the overlap below the threshold, then the sorted arrays are
intersected exactly, and links make components.  Nodes that share a long list
but are still in different components meet in tiles of blocks of that list,
again under the bitmap bound, best first, until no pair is left untried; pairs
inside a component are never made, so a large group of copies costs a star, not
its square.

Results for odd input: null or wordless text has an empty set and is a
component of its own; rows that share an id keep a row each; a component's id
is the smallest non-null id in it (null if it has none); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import wordhash as wh
from lodestar.llm.base import near, query, read, small_batches, store, trimmed

K = 5
SHORT = 8            # up to so many nodes of a list meet pairwise at once
BLOCK = 2048         # nodes of a long list in one side of a tile
WORDS = 1 << 20      # 64-bit words of bitmaps compared at a time in a tile
BEST = 3             # candidates that a node outside a tile's largest component tries in a guided round
BITS = 2             # bitmap bits per element, at least


def need(total):
    """Smallest overlap of two sets with sizes adding up to ``total`` that links
    them: 100 * o >= 80 * (total - o)."""
    return (4 * total + 8) // 9


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    return np.unique(wh.window_hashes(h, min(K, len(h)))) if len(h) else np.zeros(0, np.uint64)


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offsets in wh.chunks(column):
        starts, ends, first = wh.spans(data, offsets)
        h = wh.word_hashes(data, starts, ends, lower=True)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield shingle_set(h[a:b])


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of elements per bit; BITS for each element, rounded up to a power of two."""
    bits = 1 << max(6, (BITS * len(s) - 1).bit_length())
    count = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(b: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of fewer bytes: the parity of the folded bits."""
    return np.bitwise_xor.reduce(b.reshape(-1, size), axis=0) if len(b) > size else b


def coarse(b: bytes, n: int) -> bytes:
    """The bitmap folded to a bit an element, 512 bits at least, for the tiles: two
    unlike sets of n elements differ in some n / 2 of n bits, far above the n / 5
    that a link allows (of n / 2 bits they differ in n / 4, too near)."""
    size = max(64, (1 << max(9, (n - 1).bit_length())) // 8)
    return fold(np.frombuffer(b, np.uint8), size).tobytes() if len(b) > size else b


def _digest(s: np.ndarray, salt: int) -> int:
    x = wh.mix(s + np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(wh.mix(np.array([x], np.uint64)).view(np.int64)[0])


SIGNATURE = "doc_id bigint, tag bigint, n bigint, node bigint, proof bigint, keys array<bigint>, bits binary, small binary"


def _signatures(salt: int):
    def run(batches):
        for batch in batches:
            n, node, proof, keys, bits, small, seen = [], [], [], [], [], [], set()
            for s in sets_of(batch.column(1)):
                n.append(len(s))
                if not len(s):
                    node.append(None), proof.append(None), keys.append(None), bits.append(None), small.append(None)
                    continue
                node.append(_digest(s, 1 + salt)), proof.append(_digest(s, 2 + salt))
                if (node[-1], proof[-1]) in seen:         # a copy within the batch needs no keys of its own
                    keys.append(None), bits.append(None), small.append(None)
                    continue
                seen.add((node[-1], proof[-1]))
                keys.append(s[:len(s) - (4 * len(s) + 4) // 5 + 1].view(np.int64)), bits.append(bitmap(s))
                small.append(coarse(bits[-1], len(s)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(proof, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(small, pa.binary())],
                names=["doc_id", "tag", "n", "node", "proof", "keys", "bits", "small"])
    return run


def _columns(batch, *names):
    return [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]


MEETS = "token bigint, a bigint, na bigint, b bigint, nb bigint, long boolean"


def _lists(batches):
    """Sorted (token, n, node) rows to meetings.  A run of one token may span
    batches; only its first SHORT nodes or its band are kept."""
    def emit(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.bool_()], strict=True)],
                                          names=["token", "a", "na", "b", "nb", "long"])

    token, members, band = None, [], None      # members: (n, node) until the list is long; then the band's smallest size

    def short(out):
        for i, (ni, i_) in enumerate(members):
            for nj, j_ in members[i + 1:]:
                if 5 * ni >= 4 * nj:
                    out.append((token, j_, nj, i_, ni, False))

    def add(n, node, out):
        nonlocal band
        if 5 * band < 4 * n:
            band = n
        out.append((token, node, n, None, band, True))

    last = None
    for batch in batches:
        t, n, node = _columns(batch, "token", "n", "node")
        out = []
        if len(t):
            # rows alone with their token, away from the batch's edges, need no look
            alone = np.ones(len(t), bool)
            alone[1:] &= t[1:] != t[:-1]
            alone[:-1] &= t[1:] != t[:-1]
            alone[0] = alone[-1] = False
            look = np.flatnonzero(~alone)
            for ti, ni, di in zip(t[look].tolist(), n[look].tolist(), node[look].tolist(), strict=True):
                if ti != token:
                    if band is None:
                        short(out)
                    token, members, band = ti, [], None
                elif last == di:
                    continue
                last = di
                if band is not None:
                    add(ni, di, out)
                else:
                    members.append((ni, di))
                    if len(members) > SHORT:
                        band = members[0][0]
                        for m in members:
                            add(*m, out)
                        members = []
        if len(out) > 0:
            yield emit(out)
    out = []
    if band is None and members:
        short(out)
    yield emit(out)


def _bound(na, nb, bits_a, bits_b) -> np.ndarray:
    """Whether the bitmaps allow a link, pair by pair."""
    keep = np.zeros(len(na), bool)
    for i, (x, y) in enumerate(zip(bits_a, bits_b, strict=True)):
        x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
        keep[i] = (na[i] + nb[i] - differ) // 2 >= need(na[i] + nb[i])
    return keep


def _prune(batches):
    for batch in batches:
        na, nb = _columns(batch, "na", "nb")
        keep = _bound(na, nb, batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
        yield batch.select(["a", "na", "b", "nb"]).filter(pa.array(keep))


def _unpack(packed) -> list[np.ndarray]:
    z = zstandard.ZstdDecompressor()
    texts = pa.array([z.decompress(x).decode() for x in packed], pa.large_string())
    return list(sets_of(texts))


def _node_texts(salt: int):
    """Rows (node, text) whose text really has that node's set, compressed."""
    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(1)
            keep = [k for k, (s, node) in enumerate(zip(sets_of(texts), nodes, strict=True)) if len(s) and _digest(s, 1 + salt) == node]
            packed = [z.compress((texts[k].as_py() or "").encode()) for k in keep]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in keep], pa.int64()), pa.array(packed, pa.binary())], names=["node", "packed"])
    return run


def _verify(batches):
    """Rows sorted by (hub, member), the hub's own first: exact intersection of
    each member's sorted array with its hub's."""
    own = None
    for batch in batches:
        hubs, members, parts = _columns(batch, "hub", "member", "part")
        a, b = [], []
        for h, m, part, s in zip(hubs.tolist(), members.tolist(), parts.tolist(), _unpack(batch.column("packed").to_pylist()), strict=True):
            if part == 0:                  # the hub itself comes first
                own = s
            elif len(np.intersect1d(own, s, assume_unique=True)) >= need(len(own) + len(s)):
                a.append(m), b.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


TILE = "a bigint, na bigint, b bigint, nb bigint"


def _tile(best: int | None):
    """One tile: rows (side, node, n, label, bits); pairs of different labels
    that sizes and bitmaps allow.  With ``best``, a node outside the tile's
    largest component keeps that many at most; if that cuts any off, a row with
    na = -1 says so of the tile's token."""
    def run(key, table):
        side, node, n, label = (table.column(x).to_numpy() for x in ("side", "node", "n", "label"))
        order = np.lexsort((node, n))
        side, node, n, label = side[order], node[order], n[order], label[order]
        bits = table.column("bits").combine_chunks()
        edge, data = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset:bits.offset + len(bits) + 1], np.frombuffer(bits.buffers()[2], np.uint8)
        raw = lambda k: data[edge[order[k]]:edge[order[k] + 1]]  # noqa: E731  a view: the bitmaps are held once
        width = np.diff(edge)[order]
        same = key[1].as_py() == key[2].as_py()
        names, counts = np.unique(label, return_counts=True)
        out = label != names[counts.argmax()]             # outside the largest component
        right = np.flatnonzero(side == (0 if same else 1))
        found, cut = [], False
        for w in np.unique(width[out]):                   # outsiders of either side against all of the other
            for of in ((0,) if same else (0, 1)):
                rows = np.flatnonzero(out & (width == w) & (side == of))
                others = right if of == 0 else np.flatnonzero(side == 0)
                for r in range(0, len(rows), 64):
                    i = rows[r:r + 64]
                    cols = others[(5 * n[others] >= 4 * n[i[0]]) & (4 * n[others] <= 5 * n[i[-1]])]
                    hits = []
                    for v in np.unique(width[cols]):
                        x = np.stack([fold(raw(k), min(w, v)) for k in i]).view(np.uint64)
                        group, step = cols[width[cols] == v], max(1, WORDS // x.size)
                        for c in range(0, len(group), step):
                            j = group[c:c + step]
                            y = np.stack([fold(raw(k), min(w, v)) for k in j]).view(np.uint64)
                            differ = np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                            total = n[i][:, None] + n[j][None, :]
                            ok = ((total - differ) // 2 >= need(total)) & (label[i][:, None] != label[j][None, :])
                            ok &= 5 * np.minimum(n[i][:, None], n[j][None, :]) >= 4 * np.maximum(n[i][:, None], n[j][None, :])
                            p, q = np.nonzero(ok)
                            hits.append((i[p], j[q], differ[p, q]))
                    if not hits:
                        continue
                    a, b, differ = (np.concatenate(h) for h in zip(*hits, strict=True))
                    if best is not None:
                        by = np.lexsort((differ, a))
                        a, b = a[by], b[by]
                        keep = np.arange(len(a)) - np.searchsorted(a, a) < best
                        cut |= not keep.all()
                        a, b = a[keep], b[keep]
                    found.append((node[a], n[a], node[b], n[b]))
        if cut:
            found.append(([key[0].as_py()], [-1], [None], [None]))
        cols = [[y for f in found for y in f[k]] for k in range(4)]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "na", "b", "nb"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable.  Each round takes
    the neighbours' smallest label, then the label's own label, so long chains
    shorten by half."""
    both = store(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-edges")
    labels = store(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "jaccard-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = store(step.join(own, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "jaccard-labels")
        labels = step.drop("old")
        if step.where("old <> label").isEmpty():
            return labels


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, tag (hash of the text: it tells rows
    that share an id apart), n_shingles, node, component_id."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    salt = 0
    while True:            # a clash of node digests (sets differ, digests agree) is found by the proof: take other digests
        signed = store(tagged.mapInArrow(trimmed(_signatures(salt)), SIGNATURE), "jaccard-signatures")
        nodes = store(signed.where("n > 0").groupBy("node", "n").agg(
            F.min("doc_id").alias("rep"), F.min("proof").alias("p0"), F.max("proof").alias("p1"),
            F.max("bits").alias("bits"), F.max("small").alias("small")), "jaccard-nodes")
        if nodes.where("p0 <> p1").isEmpty():
            break
        salt += 2
    met = (signed.where("keys is not null").select(F.explode("keys").alias("token"), "n", "node")
           .repartition("token").sortWithinPartitions("token", "n", "node"))
    met = store(met.mapInArrow(trimmed(_lists), MEETS), "jaccard-lists")

    bits = nodes.select("node", "bits")

    def candidates(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a <> b").groupBy("a", "na", "b", "nb").agg(F.lit(1)).select("a", "na", "b", "nb")
        with_bits = (pairs.join(bits.withColumnsRenamed({"node": "a", "bits": "bits_a"}), "a")
                     .join(bits.withColumnsRenamed({"node": "b", "bits": "bits_b"}), "b").select("a", "na", "b", "nb", "bits_a", "bits_b"))
        return store(with_bits.mapInArrow(trimmed(_prune), TILE), "jaccard-candidates")

    long = met.where("long").select("token", F.col("a").alias("node"), F.col("na").alias("n"), F.col("nb").alias("band"))
    share = long.groupBy("node").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    hubs = store(long.join(share, "node").groupBy("token", "band").agg(F.max(F.struct("share", "node", "n")).alias("hub")), "jaccard-hubs")
    stars = long.join(hubs, ["token", "band"]).select(F.col("node").alias("a"), F.col("n").alias("na"), "hub.node", "hub.n")
    after = F.lag("hub").over(Window.partitionBy("token").orderBy("band"))
    steps = hubs.withColumn("after", after).where("after is not null").select("hub.node", "hub.n", "after.node", "after.n").toDF("a", "na", "b", "nb")
    tried = candidates(met.where("not long").select("a", "na", "b", "nb").union(stars)
                       .union(steps.where("5 * least(na, nb) >= 4 * greatest(na, nb)")))

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
        reps = near(store(nodes.select("node", "rep").join(wanted, "node", "left_semi"), "jaccard-wanted"))
        texts = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
        return texts.mapInArrow(trimmed(_node_texts(salt)), "node bigint, packed binary")

    def links(pairs: DataFrame) -> DataFrame:
        # a hub of very many members is dealt to several tasks, each with a copy of the hub's text
        deal = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / 1024).cast("int").alias("salts"))
        members = pairs.select(F.col("b").alias("hub"), F.col("a").alias("node")).join(deal, "hub").select(
            "hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("part"), "node")
        hubs = deal.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("part"), F.col("hub").alias("node"))
        rows = hubs.union(members).join(texts_of(pairs), "node").select("hub", "salt", "part", F.col("node").alias("member"), "packed")
        rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "part", "member")
        return store(rows.mapInArrow(trimmed(_verify), "a bigint, b bigint").where("a <> b"), "jaccard-links")

    linked = links(tried)
    labels = components(linked)
    lists, best = long.drop("band"), BEST
    while True:
        held = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = held.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("token")
        lists = store(held.join(mixed, "token", "left_semi").select("token", "node", "n", "label"), "jaccard-open")
        if lists.isEmpty():
            break
        met = _tiles(lists, nodes.select("node", F.col("small").alias("bits")), best)
        up = F.struct(F.col("a").alias("x"), F.col("na").alias("nx"))
        down = F.struct(F.col("b").alias("x"), F.col("nb").alias("nx"))
        more = met.where("na >= 0").select(F.least(up, down).alias("p"), F.greatest(up, down).alias("q")).distinct()
        more = more.select("p.*", "q.*").toDF("a", "na", "b", "nb")
        more = candidates(more.join(tried.select("a", "b"), ["a", "b"], "left_anti")
                          .join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))
        found = links(more)
        linked_more = not found.isEmpty()
        if linked_more:
            tried, linked = tried.union(more), linked.union(found)
            labels = components(linked)
        # lists of which no candidate was cut off are done
        lists = lists.drop("label").join(met.where("na < 0").select(F.col("a").alias("token")).distinct(), "token", "left_semi")
        best = None                               # then all the others are tried

    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(ids, "label").select("node", "component_id")
    own = signed.where("n = 0").select("doc_id", "tag", F.col("n").alias("n_shingles"), "node", F.col("doc_id").alias("component_id"))
    rest = signed.where("n > 0").select("doc_id", "tag", F.col("n").alias("n_shingles"), "node")
    return rest.join(named, "node").select("doc_id", "tag", "n_shingles", "node", "component_id").union(own)


def _tiles(lists: DataFrame, bits: DataFrame, best: int | None) -> DataFrame:
    """Long lists with several components, in tiles of BLOCK x BLOCK nodes;
    blocks too far apart in size never meet."""
    place = F.row_number().over(Window.partitionBy("token").orderBy("n", "node")) - 1
    placed = lists.withColumn("block", F.floor(place / BLOCK).cast("int"))
    blocks = placed.groupBy("token", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"))
    other = blocks.withColumnsRenamed({"block": "j", "n0": "m0", "n1": "m1"})
    tiles = blocks.join(other, "token").where("j >= block and 5 * n1 >= 4 * m0").select("token", F.col("block").alias("i"), "j")
    left = placed.join(tiles, "token").where("block = i").withColumn("side", F.lit(0))
    right = placed.join(tiles.where("j > i"), "token").where("block = j").withColumn("side", F.lit(1))
    rows = left.unionByName(right).join(bits, "node").select("token", "i", "j", "side", "node", "n", "label", "bits")
    return store(rows.groupBy("token", "i", "j").applyInArrow(_tile(best), TILE), "jaccard-tiles")


def one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows linked to a smaller id; rows without shingles
    and rows with a null id stay.  Rows that share an id are judged each by its
    own text."""
    got = link_components(docs).where("n_shingles > 0 and doc_id <> component_id")
    gone = store(got.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).distinct(), "jaccard-dropped")
    return docs.join(gone, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__tag")), "left_anti")


@query("op10_ngram_jaccard")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
