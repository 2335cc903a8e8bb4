"""Groups of rows that share keys and pass a check: candidates through leaders, then connected components.

A key may be held by a third of all rows, so its rows are never paired with each other. First each row is checked
against one leader of each of its keys; links found so merge rows into components. Then only keys that still hold
several components matter, for further rounds with other leaders, and in the end every remaining pair of rows of
different components that share a key and may be linked is checked, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import mixed

LEADER_ROUNDS = 3
#: Keys that a task gathers before it deals them out, keys to a bucket, about, and pairs that are passed on together.
GATHER, BUCKET_KEYS, CHUNK = 1 << 20, 1 << 21, 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over edges (a, b), for all ids that have a smaller one.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each a min per node and a join.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.*")
        now = written(small.where("u <> v").distinct(), "edges")
        mark, before = _mark(now), mark
        if mark == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def frequent_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys (key, id) whose key is held by two different ids at least."""
    held = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    return written(keys.join(held, "key"), "keys")


def _runs(key: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of key and ident, by key; where each key's run begins, and whether the pair's run has several."""
    order = np.lexsort((ident, key))
    key, ident = key[order], ident[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])]) if len(key) else np.zeros(0, bool)
    key, ident = key[new], ident[new]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    several = np.repeat(np.diff(np.append(begin, len(key))) > 1, np.diff(np.append(begin, len(key))))
    return key, ident, begin, several


def shared_keys(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], expected: int) -> DataFrame:
    """(key, id), without repeats, of the keys that two different ids hold at least.

    keys_of: from a batch of rows to keys and ids. A task sorts what it gathered: pairs whose key is held twice there
    are passed on as they are, spread over all buckets, and of each key one goes to the key's bucket, as a part of one
    array for each bucket, where the keys that several tasks hold are found. So a key that all rows hold is one entry
    for each GATHER keys in its bucket, however many rows hold it. expected: keys in all, which sets the buckets.
    """
    spark = rows.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // BUCKET_KEYS))

    def dealt(parts: list) -> pa.RecordBatch:
        key, ident, begin, several = _runs(*(np.concatenate(x) for x in zip(*parts)))
        sure_key, sure_ident = key[several], ident[several]
        out = []
        for lo in range(0, len(sure_key), CHUNK):
            k, i = sure_key[lo : lo + CHUNK], sure_ident[lo : lo + CHUNK]
            out.append((int(mixed(k + i.view(np.uint64)).sum(dtype=np.uint64) % np.uint64(buckets)), True, k.tobytes(), i.tobytes()))
        key, ident = key[begin], ident[begin]
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out += [(k, False, key[order[p:q]].tobytes(), ident[order[p:q]].tobytes()) for k, (p, q) in enumerate(zip(ends[:-1], ends[1:])) if q > p]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["bucket", "sure", "keys", "ids"])

    def deal(batches):
        parts, held = [], 0
        for batch in batches:
            parts.append(keys_of(batch))
            held += len(parts[-1][0])
            if held >= GATHER:
                yield dealt(parts)
                parts, held = [], 0
        if held:
            yield dealt(parts)

    def met(table: pa.Table) -> pa.Table:
        def pairs(some: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            read = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in some.column(name))])
            return read("keys", np.uint64), read("ids", np.int64)

        key, ident, _, several = _runs(*pairs(table.filter(pc.invert(table.column("sure")))))
        sure_key, sure_ident = pairs(table.filter(table.column("sure")))
        return pa.table({"key": np.concatenate([key[several], sure_key]).view(np.int64), "id": np.concatenate([ident[several], sure_ident])})

    entries = rows.mapInArrow(deal, "bucket int, sure boolean, keys binary, ids binary")
    return entries.groupBy("bucket").applyInArrow(met, "key long, id long").distinct()


def linked(
    keys: DataFrame, about: DataFrame, near: Callable[[str, str], Column], confirm: Callable[[DataFrame], DataFrame], rounds: int = LEADER_ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """(id, root) of ids with a smaller one in their group, and the confirmed links (a, b).

    keys: (key, id), each key held by two ids at least. about: (id, ...) long numbers that the cheap check needs, without
    nulls. near("a", "b"): that check, over columns of about with the prefixes a_ and b_; it must hold for every link.
    confirm: from pairs (a, b) to the links. rounds: with leaders, before the last step.
    """
    cols = [c for c in about.columns if c != "id"]
    held = written(about.join(keys.select("id").distinct(), "id", "left_semi"), "about")
    side = lambda p: held.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    checked = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").where(near("a", "b")).select("a", "b")
    open_keys, links, roots = keys.withColumn("root", F.col("id")), None, None
    for k in range(rounds):
        by = F.xxhash64("id", F.lit(k)) if k else F.lit(0)
        first = F.min(F.struct(by.alias("by"), F.col("id").alias("a"), F.col("root").alias("a_root"))).alias("first")
        leaders = open_keys.groupBy("key").agg(first).select("key", "first.a", "first.a_root")
        pairs = open_keys.select("key", F.col("id").alias("b"), "root").join(leaders, "key").where("root <> a_root").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = written(confirm(written(checked(pairs), "pairs")), "links")
        links = found if links is None else links.unionByName(found)
        if roots is None or not found.isEmpty():
            roots = written(components(links), "roots")
            open_keys = written(_open(keys, roots), "open-keys")
        if open_keys.isEmpty():
            return roots, links
    # every pair of rows of different components that still share a key. All that `near` needs is in the join, so it puts
    # out little more than links; columns that can't be null keep its code short enough to be compiled
    sure = lambda c, p: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(f"{p}_{c}")
    x, y = (open_keys.join(held, "id").select("key", F.col("id").alias(p), sure("root", p), *[sure(c, p) for c in cols]) for p in "ab")
    rest = x.join(y, "key").where(F.col("a_root") < F.col("b_root")).where(near("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = written(confirm(written(rest, "pairs")), "links")
    links = links.unionByName(found)
    return (roots if found.isEmpty() else components(links)), links


def _open(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of keys that more than one component holds, with their root."""
    now = keys.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    many = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return now.join(many, "key")
