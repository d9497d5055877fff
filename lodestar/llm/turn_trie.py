"""Conversation prefix trie from padded turn-id matrices.

A turn is a pair of 64-bit hashes of (position, role, text); a prefix is the
exclusive-or of its turns' pairs.  Conversations are cut into bands of BAND
turns, so no row grows with a conversation; a band carries the prefix before it.
Bands are range-sharded by (band, prefix, turns, conversation): a shard is a
bounded number of rows, whatever the size of a group of equal conversations.  In
a shard the bands are a padded matrix; ``numpy.lexsort`` puts equal prefixes
together, the change masks of the columns, OR-accumulated from the left, mark
where a node starts at each depth, and ``reduceat`` over these starts aggregates
a depth at once.  Nodes that touch a shard's first or last row may go on in the
next shard; only these are grouped again by depth and prefix.

Two passes.  The first gives nodes, members and parents, and from them, for each
conversation, the depth from which it is its nodes' smallest member.  A turn of a
conversation is saved exactly above that depth, and a leaf counts for its
smallest member; so both subtree sums are plain sums over members, which the
second pass takes with the same starts.

Order inside a conversation: turn (null first), then role, then text; null roles
and texts are empty.  Positions come from range-sorted partitions and the rows
of earlier partitions, so a conversation of any length is spread over tasks.

Results for odd input: rows without a conv_id belong to no conversation and are
left out; equal rows and equal turn numbers are turns of their own; a
conversation whose turns all fall away is a member of the root; an empty table
has no nodes; other columns are not read.

The digest of a node's ends is one running SHA-256, which no two tasks can
share; ids are joined in sorted shards, and for a node that spans shards the
joined pieces are hashed in order as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.base import query, read, small_batches, store

BAND = 64                # turns in a row of a matrix
SHARD = 8192             # rows of a matrix, about
PIECE = 1 << 18          # characters of joined ids handed on at a time
NOTHING = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "k1", "k2"]


def shards(rows: int) -> int:
    return max(1, -(-rows // SHARD))


def head_turns(conv: Column) -> Column:
    """h: turns taken over from the first conversation of the hundred."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


LOCAL = "part int, conv_id bigint, place bigint, t1 bigint, t2 bigint, chars bigint"


def _places(batches):
    """Sorted rows to rows with their 1-based place in the partition's run of their conversation."""
    last, seen = None, 0
    for batch in batches:
        conv = batch.column(1).to_numpy()
        if not len(conv):
            continue
        start = np.r_[0, np.flatnonzero(conv[1:] != conv[:-1]) + 1]
        place = np.arange(len(conv)) - np.repeat(start, np.diff(np.r_[start, len(conv)])) + 1
        if conv[0] == last:
            place[:start[1] if len(start) > 1 else len(conv)] += seen
        last, seen = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place, pa.int64()), *[batch.column(k) for k in (2, 3, 4)]],
                                         names=["part", "conv_id", "place", "t1", "t2", "chars"])


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (1-based), two turn hashes and code points of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "conv_id", F.xxhash64("role", "text").alias("t1"),
        F.xxhash64("text", F.lit(1), "role").alias("t2"), F.length("text").cast("bigint").alias("chars"))
    rows = store(rows.mapInArrow(_places, LOCAL), "trie-turns")
    # a conversation goes on from at most one earlier run a partition: as many rows as partitions
    runs = rows.groupBy("conv_id", "part").agg(F.max("place").alias("rows"))
    earlier = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = runs.withColumn("before", earlier).where("before is not null").select("conv_id", "part", "before")
    return rows.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Per conversation the first turns of the first of its hundred, then its own turns from there on."""
    base, h = F.col("conv_id") - F.col("conv_id") % 100, head_turns(F.col("conv_id"))
    heads = turns.where("pos <= 5 and conv_id % 100 = 0").groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "chars"))).alias("head"))
    convs = turns.where("pos = 1").select("conv_id", base.alias("base"), h.cast("int").alias("h")).join(heads, "base", "left")
    first = convs.where("h > 0 and head is not null").select("conv_id", F.inline(F.slice("head", F.lit(1), F.col("h"))))
    own = turns.where(F.col("pos") > h).withColumn("base", base).join(heads.select("base", F.size("head").alias("n")), "base", "left")
    taken = F.least(h, F.coalesce("n", F.lit(0)))
    own = own.select("conv_id", (F.col("pos") - h + taken).alias("pos"), "t1", "t2", "chars")
    return first.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "t1", "t2", "chars").union(own)


def bands_of(turns: DataFrame) -> DataFrame:
    """conv_id, band, prefix before it (k1, k2), code points before it (before),
    its turns as an array of (z1, z2, chars), and the prefix after it (e1, e2)."""
    z = turns.select("conv_id", "pos", F.floor((F.col("pos") - 1) / BAND).cast("bigint").alias("band"), "chars",
                     F.xxhash64("t1", "t2", "pos").alias("z1"), F.xxhash64("pos", "t2", "t1").alias("z2"))
    rows = store(z.groupBy("conv_id", "band").agg(
        F.sort_array(F.collect_list(F.struct("pos", "z1", "z2", "chars"))).alias("turns"),
        F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"), F.sum("chars").alias("chars")), "trie-bands")
    # only conversations of several bands need what stands before a band
    several = rows.where("band > 0").select("conv_id").distinct()
    up_to = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.join(several, "conv_id", "left_semi").select(
        "conv_id", "band", F.bit_xor("x1").over(up_to).alias("k1"), F.bit_xor("x2").over(up_to).alias("k2"), F.sum("chars").over(up_to).alias("before"))
    later = rows.where("band > 0").join(before.where("band > 0"), ["conv_id", "band"])
    zero = F.lit(0).cast("bigint")
    got = rows.where("band = 0").select("*", zero.alias("k1"), zero.alias("k2"), zero.alias("before")).unionByName(later)
    turns = F.transform("turns", lambda t: F.struct(t["z1"].alias("z1"), t["z2"].alias("z2"), t["chars"].alias("chars")))
    return got.select("conv_id", "band", "k1", "k2", "before", turns.alias("turns"), F.size("turns").cast("bigint").alias("n"),
                      F.col("k1").bitwiseXOR(F.col("x1")).alias("e1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("e2"),
                      (F.col("before") + F.col("chars")).alias("after"))


def sharded(rows: DataFrame, count: int) -> DataFrame:
    return rows.repartitionByRange(shards(count), "band", "k1", "k2", "turns", "conv_id")


class Matrix:
    """A shard's bands: padded matrices in lexicographic order and, per column,
    where nodes start."""

    def __init__(self, table: pa.Table):
        column = lambda c: table.column(c).to_numpy()
        turns = table.column("turns").combine_chunks()
        offsets = np.asarray(turns.offsets)
        n = np.diff(offsets)
        rows, width = len(n), int(n.max())
        flat = np.repeat(np.arange(rows), n), np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], n)

        def padded(field, empty):
            m = np.full((rows, width), empty, np.int64)
            m[flat] = turns.values.field(field).to_numpy()[offsets[0]:offsets[-1]]
            return m
        least = np.iinfo(np.int64).min            # a shorter band comes first, as in the order of the shards
        z1, z2, chars = padded("z1", least), padded("z2", least), padded("chars", 0)
        band, k1, k2 = column("band"), column("k1"), column("k2")
        order = np.lexsort([x for c in range(width - 1, -1, -1) for x in (z2[:, c], z1[:, c])] + [k2, k1, band])
        self.order, self.n, self.z1, self.z2, self.chars = order, n[order], z1[order], z2[order], chars[order]
        self.band, self.k1, self.k2, self.before = band[order], k1[order], k2[order], column("before")[order]
        differ = np.ones((rows, width), bool)
        differ[1:] = (self.z1[1:] != self.z1[:-1]) | (self.z2[1:] != self.z2[:-1])
        group = (self.band[1:] != self.band[:-1]) | (self.k1[1:] != self.k1[:-1]) | (self.k2[1:] != self.k2[:-1])
        differ[1:, 0] |= group
        self.starts = np.logical_or.accumulate(differ, axis=1)
        self.p1 = np.bitwise_xor.accumulate(np.column_stack([self.k1, self.z1]), axis=1)
        self.p2 = np.bitwise_xor.accumulate(np.column_stack([self.k2, self.z2]), axis=1)
        self.so_far = self.before[:, None] + np.cumsum(self.chars, axis=1) - self.chars       # code points before each column

    def nodes(self):
        """Per column: rows that reach it, starts among them, first row of each node, whether it may go on in another shard."""
        for c in range(self.z1.shape[1]):
            rows = np.flatnonzero(self.n > c)
            at = np.flatnonzero(self.starts[rows, c])
            first = rows[at]
            end = rows[np.r_[at[1:], len(rows)] - 1]
            yield c, rows, at, first, (first == 0) | (end == len(self.n) - 1)


def _gathered(batches) -> pa.Table | None:
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None


FIRST = "depth bigint, k1 bigint, k2 bigint, u1 bigint, u2 bigint, conv_id bigint, n bigint, before bigint, open boolean"


def _first_pass(batches):
    table = _gathered(batches)
    if table is None:
        return
    m = Matrix(table)
    conv = table.column("conv_id").to_numpy()[m.order]
    for c, rows, at, first, open_ in m.nodes():
        n = np.diff(np.r_[at, len(rows)])
        cols = [m.band[first] * BAND + c + 1, m.p1[first, c + 1], m.p2[first, c + 1], m.p1[first, c], m.p2[first, c],
                np.minimum.reduceat(conv[rows], at), n, m.so_far[first, c]]
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols], pa.array(open_)],
                                         names=[x.split()[0] for x in FIRST.split(", ")])


SECOND = "depth bigint, k1 bigint, k2 bigint, saved bigint, leaves bigint, open boolean"


def _second_pass(batches):
    table = _gathered(batches)
    if table is None:
        return
    m = Matrix(table)
    shared, leaf = (table.column(c).to_numpy()[m.order] for c in ("shared", "leaf"))
    for c, rows, at, first, open_ in m.nodes():
        saved = np.maximum(shared[rows] - m.so_far[rows, c], 0)
        cols = [m.band[first] * BAND + c + 1, m.p1[first, c + 1], m.p2[first, c + 1], np.add.reduceat(saved, at), np.add.reduceat(leaf[rows], at)]
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols], pa.array(open_)],
                                         names=[x.split()[0] for x in SECOND.split(", ")])


def joined_again(pieces: DataFrame, **how: Column) -> DataFrame:
    """Whole nodes as they are, those at a shard's edge aggregated over their shards."""
    edge = pieces.where("open").groupBy(*KEY).agg(*[x.alias(c) for c, x in how.items()])
    return pieces.where("not open").select(*KEY, *how).union(edge)


PIECES = "depth bigint, k1 bigint, k2 bigint, first bigint, ids string, sha string"


def _joined_ids(batches):
    """Rows sorted by (node, conv_id): the digest of the ids of a node that lies
    within the partition and is short, else pieces of its joined ids."""
    names, kinds = [x.split()[0] for x in PIECES.split(", ")], [pa.int64()] * 4 + [pa.string()] * 2
    node, ids, size, apart, out = None, [], 0, True, []        # apart: the node's ids leave as pieces

    def flush():
        text = ",".join(ids)
        out.append((*node, int(ids[0]), text, None) if apart else (*node, None, None, hashlib.sha256(text.encode()).hexdigest()))
        ids.clear()

    def rows():
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names=names)
        out.clear()
        return got

    for batch in batches:
        for *key, conv in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            key = tuple(key)
            if key != node:
                if ids:
                    flush()
                node, size, apart = key, 0, node is None       # the partition's first node may have begun in an earlier one
            elif size >= PIECE:
                apart, size = True, 0
                flush()
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        yield rows()
    if ids:
        apart = True                                           # the last may go on in the next one
        flush()
    yield rows()


def _stream_digest(batches):
    """Pieces sorted by (node, first id) to one digest a node."""
    node, sha, out = None, None, []
    names, kinds = ["depth", "k1", "k2", "sha"], [pa.int64()] * 3 + [pa.string()]
    for batch in batches:
        for *key, ids in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 4)], strict=True):
            if tuple(key) == node:
                sha.update(b",")
            else:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = tuple(key), hashlib.sha256()
            sha.update(ids.encode())
    if node is not None:
        out.append((*node, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, kinds, strict=True)], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, sha: of the ids of the conversations that end at a node, ascending, comma-joined."""
    rows = ends.select(*KEY, "conv_id").repartitionByRange(shards(ends.count()), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = store(rows.mapInArrow(_joined_ids, PIECES), "trie-ends")
    split = pieces.where("ids is not null").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return pieces.where("ids is null").select(*KEY, "sha").union(
        split.mapInArrow(_stream_digest, "depth bigint, k1 bigint, k2 bigint, sha string"))


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small_batches(turns.sparkSession)
    ordered = store(ordered_turns(turns), "trie-ordered")
    rows = store(bands_of(rebuilt(ordered)), "trie-rows")
    count = rows.count()
    matrix = ["conv_id", "band", "k1", "k2", "before", "turns"]
    pieces = store(sharded(rows.select(matrix), count).mapInArrow(_first_pass, FIRST), "trie-first")
    nodes = store(joined_again(pieces, u1=F.min("u1"), u2=F.min("u2"), conv_id=F.min("conv_id"), n=F.sum("n"), before=F.min("before")), "trie-nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = store(nodes.join(children, KEY, "left").na.fill(0, ["n_children"]), "trie-nodes")

    # of each conversation: code points above the depth from which it stands for its nodes (all, if it never does), and whether a leaf is its own
    stands = nodes.groupBy("conv_id").agg(F.min_by("before", "depth").alias("shared"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    last = F.max(F.struct("band", (F.col("band") * BAND + F.col("n")).alias("depth"), F.col("e1").alias("k1"), F.col("e2").alias("k2"), "after")).alias("last")
    ends = store(rows.groupBy("conv_id").agg(last).select("conv_id", "last.*").join(stands, "conv_id", "left").select(
        "conv_id", *KEY, F.coalesce("shared", "after").alias("shared"), F.coalesce("leaf", F.lit(0).cast("bigint")).alias("leaf")), "trie-convs")
    full = rows.select(matrix).join(ends.select("conv_id", "shared", "leaf"), "conv_id")
    sums = joined_again(store(sharded(full, count).mapInArrow(_second_pass, SECOND), "trie-second"), saved=F.sum("saved"), leaves=F.sum("leaves"))

    zero = F.lit(0).cast("bigint")
    convs = ordered.where("pos = 1").select("conv_id")
    root = (convs.select("conv_id", F.lit(1).alias("n"), zero.alias("n_children"), zero.alias("leaves"), zero.alias("saved"))
            .union(nodes.where("depth = 1").select(F.lit(None).cast("bigint"), F.lit(0), F.lit(1), zero, zero))
            .union(ends.select(F.lit(None).cast("bigint"), F.lit(0), zero, "leaf", "shared")))
    root = root.groupBy().agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "n_children", "leaves", "saved")]).where("n > 0")
    root = root.select(*[zero.alias(c) for c in KEY], *[F.lit(None).cast("bigint").alias(c) for c in ("u1", "u2")], "conv_id", "n",
                       "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("bigint").alias("leaves"), "saved")
    found = store(nodes.join(sums, KEY).select(root.columns).union(root), "trie-found")
    parents = found.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
                                                   F.col("conv_id").alias("parent_conv_id"))
    turnless = convs.join(ends, "conv_id", "left_anti").select("conv_id", *[zero.alias(c) for c in KEY])
    digests = end_digests(store(ends.select("conv_id", *KEY).union(turnless), "trie-end-rows"))
    return found.join(parents, ["depth", "u1", "u2"], "left").join(digests, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))


ORACLE = """
with recursive
bits(n, c, k) as (select range, range::bigint, 0 from range(256)
                  union all
                  select n, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select n, c from bits where k = 8),
ids as (select distinct conv_id, conv_id::varchar as s from conversations where conv_id is not null),
crc(conv_id, s, p, c) as (select conv_id, s, 1, 4294967295 from ids
                          union all
                          select conv_id, s, p + 1, xor(crc.c >> 8, tab.c) from crc
                          join tab on tab.n = xor(crc.c, ascii(substr(s, p, 1))::bigint) & 255 where p <= length(s)),
h as (select conv_id, xor(c, 4294967295) % 6 as h, conv_id - conv_id % 100 as base from crc where p > length(s)),
t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
             row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
      from conversations where conv_id is not null),
size as (select conv_id, count(*) as n from t group by conv_id),
r as (select h.conv_id, t.pos, t.role, t.text from h join t on t.conv_id = h.base and t.pos <= h.h
      union all
      select h.conv_id, t.pos - h.h + least(h.h, coalesce(size.n, 0)), t.role, t.text
      from h join t on t.conv_id = h.conv_id and t.pos > h.h left join size on size.conv_id = h.base),
seq as (select conv_id, pos as depth, text, list({'r': role, 't': text}) over (partition by conv_id order by pos) as prefix from r
        union all
        select conv_id, 0, '', [] from h),
node as (select depth, prefix, min(conv_id) as conv_id, count(*) as n, max(length(text)) as chars from seq group by depth, prefix),
member as (select seq.conv_id, seq.depth, node.conv_id as rep from seq join node on node.depth = seq.depth and node.prefix = seq.prefix),
parent as (select u.conv_id, u.depth, m.rep as parent from node u join member m on m.conv_id = u.conv_id and m.depth = u.depth - 1),
kids as (select parent as conv_id, depth - 1 as depth, count(*) as n from parent group by 1, 2),
sub as (select m.rep as conv_id, m.depth, sum((u.n - 1) * u.chars) as saved, count(*) filter (kids.n is null) as leaves
        from node u join member m on m.conv_id = u.conv_id and m.depth <= u.depth
        left join kids on kids.conv_id = u.conv_id and kids.depth = u.depth
        group by 1, 2),
final as (select conv_id, max(depth) as depth from seq group by conv_id),
ends as (select m.rep as conv_id, m.depth, sha256(string_agg(f.conv_id::varchar, ',' order by f.conv_id)) as sha
         from final f join member m on m.conv_id = f.conv_id and m.depth = f.depth group by 1, 2)
select u.conv_id, u.depth, p.parent as parent_conv_id, u.n as n_convs, coalesce(k.n, 0) as n_children,
       s.leaves as n_leaves, s.saved::bigint as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
from node u
left join parent p on p.conv_id = u.conv_id and p.depth = u.depth
left join kids k on k.conv_id = u.conv_id and k.depth = u.depth
join sub s on s.conv_id = u.conv_id and s.depth = u.depth
left join ends e on e.conv_id = u.conv_id and e.depth = u.depth
"""


@query("op12_conversation_trie", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))
