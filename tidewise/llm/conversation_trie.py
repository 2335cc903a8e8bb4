"""Prefix trie of conversations, built as a compressed (Patricia) tree and expanded once its sums are known.

A turn is a digest of role and text and its text's bytes, so texts aren't shuffled. Conversations are sorted by their
sequences of digests over all tasks. A task makes points only where its sequences branch or end, from the lengths that
neighbours share; adds up members, leaves and savings over these points; and then writes out the nodes between them, whose
savings are the point's own and a suffix sum of the edge's bytes.

Nodes that reach over a task's border contain its first or its last sequence: two paths a task, so twice the tasks by the
length of a conversation. Their parts from all tasks are added by a digest of the path. What they owe to each other is
added along the paths: each node is charged to one path that has it, suffix sums run up that path, and a node's total is
the sum over all paths that have it. So no node, not even the root, is one task's group of members; the ids of a
conversation that many repeat are hashed from texts of a thousand ids, in their order.

A conversation itself is one row of 24 bytes a turn. Nulls: turns without a conv_id are ignored, null roles and texts are
empty, a null turn comes first. Turns of one number are ordered by role, then by digest; repeated rows are turns of their
own. An empty table gives an empty result, without a root. Other columns are ignored, whatever their names. conv_id is a
whole number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Turns a task sorts, about; ids in one piece of text that is hashed later; bytes of a turn's digest.
TURNS, PIECE, WIDTH = 1 << 18, 1000, 16
_NONE = hashlib.sha256(b"").hexdigest()
_NODE, _UNDER_PATH, _ON_PATH, _IDS = range(4)
_SCHEMA = "kind int, part int, side int, depth long, path binary, parent_path binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string, piece long, ids string"
_FIELDS = [f.split()[0] for f in _SCHEMA.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of digest (hexadecimal) and bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(conversations: DataFrame, base: Column, shared: Column) -> DataFrame:
    """(conv_id, turns): the first `shared` turns of the conversation `base`, then a conversation's own after its first
    `shared`. base, shared: of conv_id."""
    own = turns(conversations).withColumn("base", base).withColumn("shared", shared.cast("int"))
    other = turns(conversations).select(F.col("conv_id").alias("base"), F.col("turns").alias("other"))
    kept = F.slice("turns", F.col("shared") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(other, "base", "left").select("conv_id", F.when(F.col("other").isNull(), kept).otherwise(F.concat(F.slice("other", F.lit(1), F.col("shared")), kept)).alias("turns"))


def _shared(digests: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Turns that each sequence shares with the one before it."""
    both = np.minimum(length[1:], length[:-1])
    ends = np.cumsum(both)
    at = np.arange(both.sum()) - np.repeat(ends - both, both)
    same = (digests[at + np.repeat(start[1:], both)] == digests[at + np.repeat(start[:-1], both)]).all(1)
    out = both.copy()
    some = np.flatnonzero(both)
    if len(some):
        out[some] = np.minimum(both[some], np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, at), (ends - both)[some]))
    return np.concatenate([[0], out])


class Points:
    """The compressed tree of sorted, different sequences: depth, parent, first and last sequence of each point; children
    come before their parents in `order`, and point 0 is the root."""

    def __init__(self, length: list[int], shared: list[int]):
        depth, parent, lo, hi, order, stack = [0], [-1], [0], [len(length) - 1], [], [0]
        self.end = {}  # of a sequence: its point

        def add(d: int, first: int) -> int:
            depth.append(d)
            parent.append(-1)
            lo.append(first)
            hi.append(-1)
            stack.append(len(depth) - 1)
            return len(depth) - 1

        for k, (n, common) in enumerate(zip(length, shared)):
            while depth[stack[-1]] > common:
                v = stack.pop()
                hi[v] = k - 1
                order.append(v)
                parent[v] = stack[-1] if depth[stack[-1]] >= common else add(common, lo[v])
            self.end[k] = add(n, k) if n > common else stack[-1]
        while len(stack) > 1:
            v = stack.pop()
            hi[v] = len(length) - 1
            order.append(v)
            parent[v] = stack[-1]
        self.order = [*order, 0]
        self.depth, self.parent, self.lo, self.hi = (np.array(x, np.int64) for x in (depth, parent, lo, hi))


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = dict(f.split() for f in _SCHEMA.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(columns[f], _TYPES[kinds[f]]) if f in columns else pa.nulls(n, _TYPES[kinds[f]]) for f in _FIELDS], names=_FIELDS)


def _part(batches):
    """The nodes of a task's sorted sequences: whole ones, and its share of those on the paths along its borders."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    part, table = TaskContext.get().partitionId(), pa.Table.from_batches(batches).combine_chunks()
    ids, keys, sizes = table.column("conv_id").to_numpy(), table.column("key").combine_chunks(), table.column("sizes").combine_chunks()
    digests = np.frombuffer(b"".join(x.as_buffer() for x in keys), np.uint64).reshape(-1, WIDTH // 8)
    length = np.array([len(x.as_buffer()) // WIDTH for x in keys], np.int64)
    start = np.cumsum(length) - length
    upto = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())]).astype(np.int64)  # bytes before a turn
    shared = _shared(digests, start, length)
    new = np.ones(len(ids), bool)
    new[1:] = (shared[1:] < length[1:]) | (length[1:] != length[:-1])
    row = np.flatnonzero(new)  # the first conversation of each sequence, with its smallest id
    ends = np.append(row[1:], len(ids))
    start, length, last = start[row], length[row], len(row) - 1
    tree = Points(length.tolist(), shared[row].tolist())
    lo, hi, depth, parent = tree.lo, tree.hi, tree.depth, tree.parent
    n = ends[hi] - row[lo]
    border = (lo == 0) | (hi == last)
    above = np.where(parent >= 0, depth[parent], -1)
    # sums over the compressed tree: smallest member, children, leaves and savings of whole nodes below
    first, kids, leaves, saved, own_kids = [None] * len(n), [0] * len(n), [0] * len(n), [0] * len(n), [0] * len(n)
    for k, v in tree.end.items():
        first[v] = int(ids[row[k]])
    at = start[lo]
    edge = np.where(border | (depth < 1), 0, (n - 1) * (upto[at + depth] - upto[at + np.maximum(above, 0)])).tolist()
    tops, on_border, parents = edge, border.tolist(), parent.tolist()
    one = np.where(border | (depth < 1), 0, (n - 1) * (upto[at + depth] - upto[at + np.maximum(depth - 1, 0)])).tolist()
    own = [0] * len(n)  # savings of each point without the rest of its edge
    for v in tree.order:
        p = parents[v]
        if not on_border[v]:
            leaves[v] += not kids[v]
        own[v] = saved[v] + one[v]
        if p >= 0:
            first[p] = first[v] if first[p] is None else min(first[p], first[v])
            kids[p] += 1
            own_kids[p] += not on_border[v]
            leaves[p] += leaves[v]
            saved[p] += saved[v] + tops[v]
    first, kids, leaves, own = (np.array(x, np.int64) for x in (first, kids, leaves, own))

    paths = []  # digests along the first and the last sequence
    for s in (0, last):
        h, found = hashlib.sha256(), [hashlib.sha256(b"").digest()[:WIDTH]]
        for d in digests[start[s] : start[s] + length[s]]:
            h.update(d.tobytes())
            found.append(h.digest()[:WIDTH])
        paths.append(found)

    # whole nodes: each point's edge, node by node
    v = np.flatnonzero(~border)
    count = (depth - above)[v]
    v = np.repeat(v, count)
    if len(v):
        d = above[v] + 1 + np.arange(len(v)) - np.repeat(np.cumsum(count) - count, count)
        is_point, is_top = d == depth[v], d == above[v] + 1
        hashes = np.full(len(v), _NONE, object)
        end_of = {p: k for k, p in tree.end.items()}
        for k in np.flatnonzero(is_point):
            s = end_of.get(int(v[k]))
            if s is not None:
                hashes[k] = hashlib.sha256(",".join(map(str, ids[row[s] : ends[s]].tolist())).encode()).hexdigest()
        under = is_top & border[parent[v]]
        parent_path = [paths[int(lo[p] > 0)][depth[p]] if u else None for u, p in zip(under.tolist(), parent[v].tolist())]
        parent_id = np.where(is_top, first[parent[v]], first[v])
        suffix = (n[v] - 1) * (upto[at[v] + depth[v] - 1] - upto[at[v] + d - 1])
        yield _rows(kind=np.where(under, _UNDER_PATH, _NODE), part=np.full(len(v), part), depth=d, parent_path=parent_path, conv_id=first[v], parent_conv_id=parent_id, n_convs=n[v], n_children=np.where(is_point, kids[v], 1), n_leaves=leaves[v], saved_tokens=own[v] + suffix, ends_sha256=hashes)

    # the paths along the borders; what both have is counted with the first
    common = next((k for k, (a, b) in enumerate(zip(*paths)) if a != b), min(map(len, paths)))
    for side, s in enumerate((0, last)):
        through = [p for p in np.flatnonzero(lo == 0 if side == 0 else hi == last)]
        through = np.array(sorted(through, key=lambda p: depth[p]))
        d = np.arange(length[s] + 1)
        p = through[np.searchsorted(depth[through], d)]
        is_point, counted = d == depth[p], d >= common * side
        share = lambda x: np.where(counted, x, 0)
        size = np.concatenate([[0], np.diff(upto[start[s] : start[s] + length[s] + 1])])
        yield _rows(kind=np.full(len(d), _ON_PATH), part=np.full(len(d), part), side=np.full(len(d), side), depth=d, path=paths[side], parent_path=[None, *paths[side][:-1]], conv_id=first[p], n_convs=share(n[p]), n_children=share(np.where(is_point, np.array(own_kids)[p], 0)), n_leaves=share(leaves[p]), saved_tokens=share(np.array(saved, np.int64)[p]), bytes=size)
        for k in sorted(k for k, q in tree.end.items() if side == int(lo[q] > 0) and border[q]):
            members, of = ids[row[k] : ends[k]], depth[tree.end[k]]
            pieces = [",".join(map(str, members[i : i + PIECE].tolist())) for i in range(0, len(members), PIECE)]
            yield _rows(kind=[_IDS] * len(pieces), part=[part] * len(pieces), path=[paths[side][of]] * len(pieces), piece=range(len(pieces)), ids=pieces)


def _hashed(batches):
    """(path, ends_sha256) of pieces that come path by path, in order."""
    path, h = None, None
    for batch in batches:
        paths, hashes = [], []
        for p, text in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist()):
            if p != path:
                if path is not None:
                    paths.append(path)
                    hashes.append(h.hexdigest())
                path, h = p, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(hashes, pa.string())], names=["path", "ends_sha256"])
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([h.hexdigest()])], names=["path", "ends_sha256"])


def _on_paths(rows: DataFrame) -> DataFrame:
    """The nodes along borders, whole: path, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    shares = rows.where(F.col("kind") == _ON_PATH)
    total = lambda c, name=None: F.sum(c).alias(name or c)
    nodes = shares.groupBy("path").agg(F.first("parent_path").alias("parent_path"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), total("n_convs"), total("n_children", "whole_children"), total("n_leaves", "whole_leaves"), total("saved_tokens", "whole_saved"), F.max("bytes").alias("bytes"), F.min(F.struct("part", "side")).alias("charged"))
    children = nodes.where("parent_path is not null").groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("more"))
    nodes = written(nodes.join(children, "path", "left").withColumn("n_children", F.col("whole_children") + F.coalesce("more", F.lit(0))).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long")).drop("whole_children", "more"), "trie-paths")
    charged = shares.select("path", "part", "side", "depth").join(nodes.select("path", "charged", "own", "leaf"), "path").withColumn("here", (F.struct("part", "side") == F.col("charged")).cast("long"))
    up = Window.partitionBy("part", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = charged.select("path", F.sum(F.col("own") * F.col("here")).over(up).alias("own"), F.sum(F.col("leaf") * F.col("here")).over(up).alias("leaf")).groupBy("path").agg(total("own", "path_saved"), total("leaf", "path_leaves"))
    pieces = rows.where(F.col("kind") == _IDS).select("path", "part", "piece", "ids")
    hashes = pieces.repartition("path").sortWithinPartitions("path", "part", "piece").mapInArrow(_hashed, "path binary, ends_sha256 string")
    parents = nodes.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(below, "path").join(hashes, "path", "left").join(parents, "parent_path", "left")
    return found.select("path", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("whole_leaves") + F.col("path_leaves")).alias("n_leaves"), (F.col("whole_saved") + F.col("path_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row for each different sequence of first turns, from (conv_id, turns) as turns() and rebuilt() give them:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key")
    flat = written(sequences.select("conv_id", key, F.transform("turns", lambda t: t["bytes"]).alias("sizes")), "trie-sequences")
    n = flat.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TURNS))
    ordered = flat.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = written(ordered.mapInArrow(_part, _SCHEMA), "trie-nodes")
    paths = written(_on_paths(rows), "trie-paths")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # a node under a path meets its parent in its own task's share of the paths, so that the root isn't one key
    near = rows.where(F.col("kind") == _ON_PATH).select("part", "path").distinct().join(paths.select("path", F.col("conv_id").alias("of_parent")), "path").withColumnRenamed("path", "parent_path")
    under = rows.where(F.col("kind") == _UNDER_PATH).join(near, ["part", "parent_path"]).withColumn("parent_conv_id", F.col("of_parent"))
    return rows.where(F.col("kind") == _NODE).select(*out).unionByName(under.select(*out)).unionByName(paths.select(*out))


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conv = F.col("conv_id")
    return prefix_trie(rebuilt(conversations, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9))


SQL = {
    "op13_conversation_trie": f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS steps),
 r AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS k, digest, bytes
       FROM (SELECT conv_id, turn, coalesce(role, '') AS role, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, {2 * WIDTH}) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
 n AS (SELECT c, count(*) AS turns FROM r GROUP BY c),
 ids AS (SELECT n.c, n.c - n.c % 5 AS base, coalesce(b.turns, 0) AS base_turns,
          xor(list_reduce(list_prepend(4294967295, list_transform(string_split(n.c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda x, s: xor(x >> 8, steps[(xor(x, s) & 255) + 1])), 4294967295) % 9 AS h
         FROM n CROSS JOIN crc LEFT JOIN n b ON b.c = n.c - n.c % 5),
 x AS (SELECT ids.c, r.k AS d, digest, bytes FROM ids JOIN r ON r.c = base WHERE k <= h
       UNION ALL SELECT ids.c, least(h, base_turns) + k - h, digest, bytes FROM ids JOIN r ON r.c = ids.c WHERE k > h),
 p AS (SELECT c, d, bytes, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM x
       UNION ALL SELECT c, 0, 0, '' FROM ids),
 q AS (SELECT *, lag(path) OVER w AS parent, d = max(d) OVER (PARTITION BY c) AS ends FROM p WINDOW w AS (PARTITION BY c ORDER BY d)),
 nodes AS (SELECT path, any_value(d) AS d, any_value(parent) AS parent, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends FROM q GROUP BY path),
 kids AS (SELECT parent AS path, count(*) AS kids FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
 w AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (path)),
 below AS (SELECT p.path, sum((w.n - 1) * w.bytes) AS saved, sum((kids = 0)::INT) AS leaves FROM w JOIN p ON p.c = w.c AND p.d <= w.d GROUP BY p.path)
SELECT w.c AS conv_id, w.d::BIGINT AS depth, up.c AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN below USING (path) LEFT JOIN nodes up ON up.path = w.parent"""
}
