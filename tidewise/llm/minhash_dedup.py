"""Near-duplicate documents: multi-index Hamming join over b-bit MinHash signatures.

A document's signature has 60 slots of 14 bits, each the hashed minimum of its shingles under one hash function. The
distance of two signatures is the number of slots that differ. The slots are split into 12 chunks of 5; by the
pigeonhole principle two signatures at most 23 apart have a chunk with at most one error, and each chunk is looked up
with each one of its slots left out, so every such pair meets in a key. At the threshold (85 of 100) 9 slots differ
on average; more than 23 do for one pair in ten million, and even most of those meet. Pairs that meet and are at most
23 apart are confirmed on their full shingle sets.

Documents with equal sets are one node, so exact copies never meet as pairs. Nulls: a null text has no words; a row
without an id has no component and stays. Rows with one id are one document. Documents without words link to nothing.
Columns other than id and text play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import frequent_keys, linked
from .store import BUCKETS, written
from .words import SPACED, gram_hashes, mixed, text_slices, word_hashes

CHUNKS, SLOTS = 12, 5
LONGS = CHUNKS * SLOTS // 4
#: Two signatures within this distance have a chunk with at most one error.
RADIUS = 2 * CHUNKS - 1
PARITY = 1024
_FACTORS = mixed(np.arange(1, CHUNKS * SLOTS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as hashes; a text of fewer words has one, the whole; without words, none."""
    none = np.zeros(0, np.uint64)
    for lo, hi, raw, at in text_slices(column):
        words, first = word_hashes(raw, at, SPACED)
        grams = gram_hashes(words, width)
        for p, q in zip(first[: hi - lo], first[1 : hi - lo + 1]):
            if q - p >= width:
                yield np.unique(grams[p : q - width + 1])
            else:
                yield gram_hashes(words[p:q], q - p) if q > p else none


def _sketches(batches, width: int):
    for batch in batches:
        n, one, two, sig, parity = [], [], [], [], []
        for grams in shingle_sets(batch.column(1), width):
            n.append(len(grams))
            parity.append(np.packbits(np.bincount((grams & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).view("<i8"))
            one.append(mixed(grams).sum(dtype=np.uint64).view(np.int64))
            two.append((mixed(grams ^ np.uint64(0x5851F42D4C957F2D))).sum(dtype=np.uint64).view(np.int64))
            if len(grams):
                least = np.fromiter(((grams * f).min() for f in _FACTORS), np.uint64, len(_FACTORS))
                sig.append((mixed(least) >> np.uint64(50)).astype("<u2").view("<i8"))
            else:
                sig.append(np.zeros(LONGS, "<i8"))
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
        for lists, width_of in ((sig, LONGS), (parity, PARITY // 64)):
            flat = np.concatenate(lists) if lists else np.zeros(0, "<i8")
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width_of, dtype=np.int32)), pa.array(flat)))
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "d1", "d2", "sig", "parity"])


def _chunk_keys(batches):
    """(key, id): for each chunk and each slot of it left out, the other slots' bits."""
    for batch in batches:
        sig = np.asarray(batch.column(1).flatten()).view("<u2").reshape(-1, CHUNKS, SLOTS).astype(np.uint64)
        ids, keys = np.asarray(batch.column(0)), []
        for chunk in range(CHUNKS):
            for left_out in range(SLOTS):
                key = np.zeros(len(sig), np.uint64)
                for slot in range(SLOTS):
                    if slot != left_out:
                        key = (key << np.uint64(14)) | sig[:, chunk, slot]
                keys.append(mixed(key + np.uint64((chunk * SLOTS + left_out + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, CHUNKS * SLOTS))], names=["key", "id"])


def distance_at_most(a: str, b: str, radius: int = RADIUS) -> Column:
    """Of signatures: a lane of 14 bits in 16 that differs carries into its bit 14, and the carries are counted."""
    carry, ones = F.lit(0x4000400040004000), F.lit(0x3FFF3FFF3FFF3FFF)
    lanes = lambda k: F.bit_count((F.col(f"{a}_s{k}").bitwiseXOR(F.col(f"{b}_s{k}")) + ones).bitwiseAND(carry))
    return reduce(lambda p, q: p + q, (lanes(k) for k in range(LONGS))) <= radius


def differing(a: str, b: str) -> Column:
    """The parity bits in which two sets differ, never more than the shingles in which they do (Sandes et al. 2017)."""
    return reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{a}_p{k}").bitwiseXOR(F.col(f"{b}_p{k}"))) for k in range(PARITY // 64)))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Links documents whose sets of `width`-word shingles share at least `percent` of 100 of their union. Every pair
    within RADIUS meets; pairs further apart that meet in a key all the same are dropped only beyond the mean distance
    at the threshold plus six deviations. A pair at 85 of 100 misses all keys once in a billion, at 80 once in ten million.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    all_rows = written(rows.mapInArrow(lambda it: _sketches(it, width), "id long, n long, d1 long, d2 long, sig array<long>, parity array<long>"), "sketches")
    nodes = written(
        all_rows.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min(F.struct("id", "n", "sig", "parity")).alias("x")).select("d1", "d2", "x.*"), "nodes"
    )
    keys = nodes.select("id", "sig").mapInArrow(_chunk_keys, "key long, id long")

    def sets(wanted: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
        some = rows.withColumn("slot", slot).join(F.broadcast(wanted.select(slot.alias("slot")).distinct()), "slot", "left_semi").select("id", "text")

        def grams(batches):
            for batch in batches:
                found = [pa.array(g.view(np.int64)) for g in shingle_sets(batch.column(1), width)]
                at = np.concatenate([[0], np.cumsum([len(g) for g in found])]).astype(np.int32)
                flat = pa.concat_arrays(found) if found else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), flat)], names=["id", "grams"])

        return some.mapInArrow(grams, "id long, grams array<long>")

    keys = frequent_keys(keys)
    full = written(sets(keys.select("id").distinct()), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        one = full.select(F.col("id").alias("a"), F.col("grams").alias("a_grams"))
        two = full.select(F.col("id").alias("b"), F.col("grams").alias("b_grams"))
        shared = F.size(F.array_intersect("a_grams", "b_grams"))
        return pairs.join(one, "a").join(two, "b").where(100 * shared >= percent * (F.size("a_grams") + F.size("b_grams") - shared)).select("a", "b").distinct()

    share = percent / 100
    radius = max(RADIUS, int(np.ceil(len(_FACTORS) * (1 - share) + 6 * np.sqrt(len(_FACTORS) * share * (1 - share)))))

    def near(a: str, b: str) -> Column:
        # at the threshold p, two sets differ in (1 - p) / (1 + p) of their sizes' sum
        sizes = F.least(f"{a}_n", f"{b}_n") * 100 >= F.greatest(f"{a}_n", f"{b}_n") * percent
        few = (100 + percent) * differing(a, b) <= (100 - percent) * (F.col(f"{a}_n") + F.col(f"{b}_n"))
        return sizes & few & distance_at_most(a, b, radius)

    flat = [F.col("sig")[k].alias(f"s{k}") for k in range(LONGS)] + [F.col("parity")[k].alias(f"p{k}") for k in range(PARITY // 64)]
    roots, _ = linked(keys, nodes.select("id", "n", *flat), near, confirm)
    node = nodes.select("d1", "d2", F.col("id").alias("node"))
    joined = all_rows.select("id", "n", "d1", "d2").join(node, ["d1", "d2"], "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "node", "id"))
    return joined.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=3, percent=85).withColumnRenamed("id", "doc_id")


SQL: dict[str, str] = {}
