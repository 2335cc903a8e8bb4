"""Exact top-k by dot product of unit vectors, in blocks of both sides.

Both tables are dealt into blocks. A task holds one block of queries and streams up to STREAM blocks of items past it, which
are read from the shared folder where they lie; it keeps the k best of each query and passes on no more than those. So no
pair of blocks is shuffled, and what a query has seen is left out in the task.

A block's items are ordered into cells of CELL rows that lie close together (halved by the widest coordinate, again and
again). The largest dot product that a query can have with a cell's box is a bound; cells whose bound is below a query's
k-th best score are not looked at. This is exact: equal scores after rounding are looked at, and ties go by the item's name.
Where vectors have few coordinates that differ, most cells are left out; in many dimensions none may be.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Folder, shared_folder
from .baskets import is_integral
from .history import top_k

#: Most rows of a block of queries and of items, least blocks of each if there are rows enough, and scores that a task holds at once.
BLOCKS, LEAST, SCORES = (16384, 32768), (32, 4), 2**22
#: Items of a cell, blocks of items that pass one task, and found entries that are sorted together.
CELL, STREAM, FOUND = 256, 32, 2**19
#: Digits of ids that are compared as numbers.
SHORT = 15


def _blocks(rows: int, side: int, block: int | None) -> int:
    return max(1, -(-rows // block) if block else max(-(-rows // BLOCKS[side]), min(LEAST[side], -(-rows // 1024))))


def _packed(df: DataFrame, key: str, blocks: int, name: str, *more: str) -> DataFrame:
    """(name, rows) of each block; a number of partitions that is given stays, so small tables have several tasks too."""
    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(name), F.struct(F.col(key).alias("id"), "vec", *more).alias("e"))
    return dealt.repartition(blocks, name).groupBy(name).agg(F.collect_list("e").alias(f"{name}_rows"))


def _matrix(vec: pa.Array) -> np.ndarray:
    return vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vec), -1) if len(vec) else np.zeros((0, 0))


def cell_order(x: np.ndarray) -> np.ndarray:
    """Rows in the order of their cells: each CELL rows that follow, from the first, are one."""
    done, left = [], [np.arange(len(x))]
    while left:
        rows = left.pop()
        cells = -(-len(rows) // CELL)
        if cells < 2:
            done.append(rows)
            continue
        some, half = x[rows], CELL * (cells // 2)
        wide = some[:, int(np.argmax(np.fmax.reduce(some) - np.fmin.reduce(some)))]
        order = np.argpartition(wide, half)
        left += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def _in_cells(batches):
    for batch in batches:
        parts = [rows.values.take(pa.array(cell_order(_matrix(rows.values.field("vec"))))) for rows in batch.column(1)]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        if parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts))], names=batch.schema.names)


def _names(ids: pa.Array, short: bool) -> np.ndarray:
    """Ids as strings, in whose order ties are broken; whole numbers from 0 below 10^SHORT as numbers in that order."""
    if short:
        size = np.asarray(ids).astype(np.uint64)
        digits = 1 + sum((size >= np.uint64(10**p)).astype(np.uint64) for p in range(1, SHORT))
        return size * np.uint64(10) ** (np.uint64(SHORT) - digits) * np.uint64(16) + digits
    return np.array(ids.cast("string").fill_null("").cast("binary").to_pylist(), dtype=np.bytes_)


class _Best:
    """The k best items so far of each query of a block, in order: scores, names, and places in a list of ids."""

    def __init__(self, users: pa.Array, k: int, short: bool):
        self.users, self.k, self.short, self.ids = users, k, short, None
        self.score, self.name, self.place = np.full((len(users), k), -np.inf), np.zeros((len(users), k), np.uint64 if short else "S1"), np.zeros((len(users), k), np.int64)
        self.found, self.held = [], 0

    def meet(self, ids: pa.Array, a: np.ndarray, b: np.ndarray, digits: int, own, self_out: bool, scores: Callable | None) -> None:
        """Takes the best of a block of items in; own: (rows, ids) that are left out; scores: of rows, if not dot products."""
        names, slack = _names(ids, self.short), 10.0**-digits
        if names.dtype.itemsize > self.name.dtype.itemsize:
            self.name = self.name.astype(names.dtype)
        self.names, self.before = names, 0 if self.ids is None else len(self.ids)
        mine = _names(self.users, self.short) if self_out else None
        known = ids.unique()
        code = np.asarray(pc.index_in(ids, value_set=known)).astype(np.int64)
        rows, seen = own
        seen = pc.index_in(seen, value_set=known, skip_nulls=True)
        here = np.asarray(seen.is_valid())
        barred = np.unique(rows[here] * len(known) + np.asarray(seen.drop_null()).astype(np.int64))
        spare = np.bincount(barred // len(known), minlength=len(a)) if len(barred) else np.zeros(len(a), np.int64)

        def look(rows: np.ndarray, lo: int, hi: int) -> None:
            inner = max(1, SCORES // (hi - lo))
            for at in range(0, len(rows), inner):
                some = rows[at : at + inner]
                s = scores(some) if scores else a[some] @ b[lo:hi].T
                least = self.score[some, -1]
                edge = np.maximum(least - slack, np.finfo(float).min)  # minus infinity is no score
                most = self.k + int(self_out) + int(spare[some].max())
                if most < hi - lo and np.isinf(least).any():
                    edge = np.maximum(edge, np.partition(s, hi - lo - most, axis=1)[:, hi - lo - most] - slack)
                r, c = np.nonzero(s >= edge[:, None])
                score, least = np.round(s[r, c], digits) + 0.0, least[r]
                r, c = some[r], c + lo
                keep = score > least
                tie = np.flatnonzero(score == least)
                keep[tie] = names[c[tie]] < self.name[r[tie], -1]
                if self_out:
                    keep &= mine[r] != names[c]
                if len(barred):
                    key = r * len(known) + code[c]
                    keep &= barred[np.minimum(np.searchsorted(barred, key), len(barred) - 1)] != key
                self.found.append((r[keep], score[keep], c[keep]))
                self.held += int(keep.sum())
                if self.held >= FOUND:
                    self.merge()

        if scores:
            look(np.arange(len(a)), 0, len(ids))
        else:
            begin = np.arange(0, len(ids), CELL)
            bound = (np.fmax.reduceat(b, begin) @ np.maximum(a, 0).T + np.fmin.reduceat(b, begin) @ np.minimum(a, 0).T) + slack
            np.nan_to_num(bound, copy=False, nan=np.inf)
            first = bound.argmax(0)  # each query's most promising cell comes first, so that others can be left out
            now = np.flatnonzero(bound[first, np.arange(len(a))] >= self.score[:, -1])
            now = now[np.argsort(first[now], kind="stable")]
            cells, at = np.unique(first[now], return_index=True)
            for cell, rows in zip(cells, np.split(now, at[1:])):
                look(rows, begin[cell], min(begin[cell] + CELL, len(ids)))
            self.merge()
            for cell in range(len(begin)):
                look(np.flatnonzero((bound[cell] >= self.score[:, -1]) & (first != cell)), begin[cell], min(begin[cell] + CELL, len(ids)))
        self.merge()
        every = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        self.ids = every.take(pa.array(self.place.ravel(), mask=np.isinf(self.score.ravel())))
        self.place = np.arange(self.place.size).reshape(self.place.shape)

    def merge(self) -> None:
        r, score, c = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.zeros(0, np.int64),) * 3
        self.found, self.held = [], 0
        if not len(r):
            return
        rows = np.unique(r)
        r = np.concatenate([np.repeat(rows, self.k), r])
        score, name = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.name[rows].ravel(), self.names[c]])
        place = np.concatenate([self.place[rows].ravel(), c + self.before])
        order = np.lexsort((name, -score, r))
        r = r[order]
        order = order[np.arange(len(r)) - np.searchsorted(r, r, "left") < self.k]
        for mine, all_of in ((self.score, score), (self.name, name), (self.place, place)):
            mine[rows] = all_of[order].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        at = np.flatnonzero(~np.isinf(self.score.ravel()))
        items = self.ids.take(pa.array(at)) if self.ids is not None else None
        return pa.RecordBatch.from_arrays([self.users.take(pa.array(at // self.k)), items, pa.array(self.score.ravel()[at])], names=["user", "item", "score"])


def top_by_dot(queries: DataFrame, items: DataFrame, k: int, *, digits: int = 6, exclude_self: bool = False, spare: DataFrame | None = None, block: int | None = None, meeting: Callable | None = None) -> DataFrame:
    """(user, item, score, rank) from (user, vec) and (item, vec); scores rounded, ties by the item as a string.

    spare: (user, item) pairs to leave out, which go to their user's block.
    meeting(a, b, marks) gives, for blocks' vectors and the items' column `mark`, a function of rows of a to their scores
    with all of b, minus infinity where two don't meet.
    """
    spark = queries.sparkSession
    q_kind, i_kind = queries.schema["user"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    whole = is_integral(items.schema["item"].dataType) and not exclude_self
    n_items, nulls, lo, hi = items.agg(F.count(F.lit(1)), F.count_if(F.col("item").isNull()), *[f("item") if whole else F.lit(None) for f in (F.min, F.max)]).first()
    short = whole and not nulls and bool(n_items) and lo >= 0 and hi < 10**SHORT
    n_q, n_i, most = _blocks(queries.count(), 0, block), _blocks(n_items, 1, block), max(1, min(k, n_items))
    has_spare, has_marks = spare is not None, "mark" in items.columns
    if has_spare:
        own = spare.groupBy("user").agg(F.collect_set(F.col("item").cast(items.schema["item"].dataType)).alias("own"))
        queries = queries.join(own, "user", "left").select("user", "vec", "own")
    q, i = _packed(queries, "user", n_q, "qb", *["own"] * has_spare), _packed(items, "item", n_i, "ib", *["mark"] * has_marks)
    if meeting is None:
        i = i.mapInArrow(_in_cells, i.schema)
    i = Folder(spark, f"{shared_folder(spark)}/tidewise-blocks").save(i, uuid.uuid4().hex).coalesce(-(-n_i // STREAM))

    def best(batches):
        lists = {}
        for batch in batches:
            for left, number, right in zip(batch.column(0), batch.column(1), batch.column(2)):
                items_of, users_of, number = left.values, right.values, number.as_py()
                if number not in lists:
                    lists[number] = _Best(users_of.field("id"), most, short)
                a, b, rows, own = _matrix(users_of.field("vec")), _matrix(items_of.field("vec")), np.zeros(0, np.int64), items_of.field("id")[:0]
                if has_spare:
                    own, sizes = users_of.field("own"), np.asarray(pc.fill_null(pc.list_value_length(users_of.field("own")), 0))
                    rows, own = np.repeat(np.arange(len(a)), sizes), own.flatten()
                marks = items_of.field("mark").to_numpy(zero_copy_only=False) if has_marks else np.zeros(len(b), int)
                lists[number].meet(items_of.field("id"), a, b, digits, (rows, own), exclude_self, meeting(a, b, marks) if meeting else None)
        for found in lists.values():
            yield found.rows()

    pairs = i.hint("shuffle_replicate_nl").crossJoin(q)
    return top_k(pairs.select("ib_rows", "qb", "qb_rows").mapInArrow(best, f"user {q_kind}, item {i_kind}, score double"), k)


def neighbours_of_copies(vectors: DataFrame, k: int, *, digits: int = 6) -> DataFrame:
    """top_by_dot() of (node, vec) among themselves without a node itself, where many vectors are equal: (user, item, score,
    rank). Equal vectors are one query, and of each only the first k + 1 nodes, by name, are searched: others come in no
    list, since ties go by name. Without it every pair of equal vectors, such as the zeros of items without a vector, is a
    tie to be looked at.
    """
    spark = vectors.sparkSession
    folder = Folder(spark, f"{shared_folder(spark)}/tidewise-blocks")
    name, kind = F.col("node").cast("string"), vectors.schema["node"].dataType.simpleString()
    vectors = folder.save(vectors, uuid.uuid4().hex)
    first = F.row_number().over(Window.partitionBy("vec").orderBy(name))
    some = folder.save(vectors.withColumn("place", first).where(F.col("place") <= k + 1), uuid.uuid4().hex)
    classes = some.where("place = 1").select(F.col("node").alias("user"), "vec")
    found = top_by_dot(classes, some.select(F.col("node").alias("item"), "vec"), k + 1, digits=digits)
    lists = found.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("near"))
    lists = folder.save(classes.join(lists, "user").select("vec", "near"), uuid.uuid4().hex)

    def own(batches):
        """A list without the node itself, for each node of its vector."""
        for b in batches:
            near, node = b.column("near"), b.column("node")
            entries, of = near.flatten(), np.repeat(np.arange(len(near)), np.asarray(pc.list_value_length(near)))
            items = entries.field("item")
            left = np.flatnonzero(np.asarray(pc.not_equal(items, node.take(pa.array(of)))))
            rank = np.arange(len(left)) - np.searchsorted(of[left], of[left], "left") + 1
            left, rank = left[rank <= k], rank[rank <= k]
            yield pa.RecordBatch.from_arrays([node.take(pa.array(of[left])), items.take(pa.array(left)), entries.field("score").take(pa.array(left)), pa.array(rank.astype(np.int32))], names=["user", "item", "score", "rank"])

    return vectors.join(lists, "vec").select("node", "near").mapInArrow(own, f"user {kind}, item {kind}, score double, rank int")
