"""Exact deduplication as a stream: keyed state on disk, without expiry, holds each digest's keeper.

The state of a digest is the best row so far (most code points, then smallest id), its locator (file and place in the
file) and the number of rows. It lives in RocksDB, partitioned by digest, and in the stream's checkpoint; it never
expires, so a copy is found however late it comes. A digest that more than one row has is a hit: the full normalised
bytes of its rows are compared, those of an earlier call's keeper by following its locator. Rows that only share the
digest are grouped by their bytes instead.

Nulls: a null text is an empty text, a null id sorts after all others. Repeated rows count as copies, one stays; which of
them is decided by the locator. An empty table gives an empty result. Columns other than id and text play no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import BUCKETS, exists, moved, shared_path, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Session settings while the stream runs; RocksDB's memory is bounded for each executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store sets MBs of disk aside
    "spark.sql.streaming.minBatchesToRetain": "2",
}
#: A digest with more than one in PIECES of all rows is dealt out in pieces of so many rows. There are at most PIECES such digests.
PIECES = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, file, row): ids and texts with their places. Other tables than plain reads of Parquet files are written first."""
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation"):
        if all(f.endswith(".parquet") for f in docs.inputFiles()) and "_metadata" not in map(str.lower, docs.columns):
            return docs.select(*columns)
    return written(docs.select(id_col, text_col), "texts").select(*columns)


def fingerprints(texts: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(id, n_chars, digest, file, row) of each row of (id, text, file, row)."""
    return texts.select("id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), digest(normalised(F.col("text"))).alias("digest"), "file", "row")


def keeper() -> Column:
    """Sorts first for the row that stays."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "file", "row")


def keyed_state(rows: DataFrame) -> DataFrame:
    """The streaming aggregation: for each digest its keeper and count. rows may be a stream or a table."""
    return rows.groupBy("digest").agg(F.min(keeper()).alias("best"), F.count(F.lit(1)).alias("n"))


def arrived(rows: DataFrame, home: str, batch: str | None = None) -> DataFrame:
    """rows as a new folder under home/arrivals, which the stream sees only once it is whole; a batch arrives once."""
    spark, new = rows.sparkSession, uuid.uuid4().hex
    name = new if batch is None else hashlib.sha256(batch.encode()).hexdigest()
    if batch is None or not exists(spark, f"{home}/arrivals/{name}"):
        rows.write.parquet(f"{home}/unfinished/{new}")
        moved(spark, f"{home}/unfinished/{new}", f"{home}/arrivals/{name}")
    return spark.read.schema(rows.schema).parquet(f"{home}/arrivals/{name}")


def run_stream(rows: DataFrame, home: str, files_per_batch: int) -> DataFrame:
    """Streams what newly arrived under home through the keyed state, in micro-batches; returns the last state of each digest."""
    spark, state = rows.sparkSession, keyed_state(rows)
    if not rows.inputFiles():
        return state
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/arrivals/*")
        query = (
            keyed_state(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{home}/stream")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{home}/changes/batch={k}"))  # the same folder if a batch runs again
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(f"{home}/changes")
    # a digest's keeper only ever improves and its count only grows
    return changes.groupBy("digest").agg(F.min("best").alias("best"), F.max("n").alias("n"))


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 512, state: str | None = None, batch: str | None = None
) -> DataFrame:
    """One row for each row of docs: id, digest, n_chars, keep_id, group_size, kept.

    Equal texts are those identical once white space is deleted. digest can be replaced (a weak one shows that bytes
    decide, not digests); files_per_batch bounds a micro-batch.

    state: a folder, shared by driver and executors, that retains the stream's checkpoint. A later call with the same
    folder (and id_col, text_col, digest) takes docs as new arrivals: they are copies of earlier calls' rows too, and sizes
    count all calls. A longer row, or one with a smaller id, replaces an earlier keeper from then on. The earlier calls'
    files must still be there; different texts of one digest are refused. Without it each call starts afresh.

    batch: a name of docs' rows in that state. A call that failed, run again with the same name and rows, counts them once.
    """
    spark, home = docs.sparkSession, (state or shared_path(docs.sparkSession, "keyed-state")).rstrip("/")
    texts = located(docs, id_col, text_col)
    rows = arrived(fingerprints(texts, digest), home, batch if state else None)
    found = written(run_stream(rows, home, files_per_batch), "keepers")
    hits = found.where("n > 1")
    members = hit_texts(texts, hits, digest)
    if state:
        members = members.unionByName(earlier_texts(spark, hits, rows, text_col, digest))
    mixed = written(differing(members), "differing")
    joined = with_keepers(rows, found)
    if mixed.isEmpty():
        return joined.select("id", "digest", "n_chars", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), is_keeper("best").alias("kept"))
    if state:
        raise ValueError("different texts share a digest; a retained state needs a stronger digest")
    return with_collisions(joined, written(other_bytes(members, hits, mixed), "other-bytes"))


def is_keeper(best: str) -> Column:
    return (F.col("file") == F.col(f"{best}.file")) & (F.col("row") == F.col(f"{best}.row"))


def with_keepers(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows with best and n of their digest. Frequent digests are dealt out, so no task gets more than a piece of one."""
    total = state.agg(F.sum("n")).first()[0] or 0
    spread = (F.col("n") * PIECES / F.lit(max(total, 1))).cast("int") + 1
    hot = F.broadcast(state.where(F.col("n") * PIECES > total).select("digest", spread.alias("spread")))  # PIECES rows at most
    dealt = lambda df: df.join(hot, "digest", "left").withColumn("spread", F.coalesce("spread", F.lit(1)))
    left = dealt(rows).withColumn("salt", F.pmod(F.xxhash64("file", "row"), "spread").cast("int"))
    right = dealt(state).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)))
    return left.drop("spread").join(right.drop("spread"), ["digest", "salt"]).drop("salt")


def hit_texts(texts: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, id, n_chars, file, row, bytes) of the rows whose digest may be a hit."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS))
    rows = texts.select("id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "file", "row", normalised(F.col("text")).alias("bytes"))
    rows = rows.withColumn("digest", digest(F.col("bytes"))).withColumn("slot", slot)
    # at most BUCKETS numbers are broadcast; they spare most rows without a copy the shuffle
    return rows.join(F.broadcast(hits.select(slot.alias("slot")).distinct()), "slot", "left_semi").drop("slot")


def earlier_texts(spark: SparkSession, hits: DataFrame, rows: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """The texts of keepers that earlier calls brought, read at their locators. Only names of files reach the driver."""
    old = hits.join(rows.select("digest").distinct(), "digest", "left_semi").select("best.*").join(rows.select("file").distinct(), "file", "left_anti")
    files = [unquote(r[0]) for r in old.select("file").distinct().collect()]
    if not files:
        return hit_texts(rows.select("id", F.lit("").alias("text"), "file", "row").limit(0), hits, digest)
    texts = spark.read.schema(f"`{text_col}` string").parquet(*files).select(F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return hit_texts(texts.join(old.select("id", "file", "row"), ["file", "row"]), hits, digest)


def differing(members: DataFrame) -> DataFrame:
    """The full check of hits: digests whose rows are not all of the same bytes. Tasks compare their own rows first."""
    return members.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where("least <> most").select("digest")


def other_bytes(members: DataFrame, hits: DataFrame, mixed: DataFrame) -> DataFrame:
    """Of digests with different texts, the rows whose bytes differ from those of the keeper."""
    some = written(members.join(mixed, "digest"), "mixed")
    best = hits.select(F.col("best.file").alias("file"), F.col("best.row").alias("row"))
    return some.join(some.join(best, ["file", "row"]).select("digest", F.col("bytes").alias("best_bytes")), "digest").where("bytes <> best_bytes").drop("best_bytes")


def with_collisions(joined: DataFrame, odd: DataFrame) -> DataFrame:
    """Groups the rows in odd by their bytes, and takes them out of their digest's group."""
    groups = odd.groupBy("digest", "bytes").agg(F.min(keeper()).alias("own"), F.count(F.lit(1)).alias("own_n"))
    own = odd.join(groups, ["digest", "bytes"]).select("file", "row", "own", "own_n")
    less = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("others"))
    is_odd = F.col("own").isNotNull()
    return (
        joined.join(less, "digest", "left")
        .join(own, ["file", "row"], "left")
        .select(
            "id",
            "digest",
            "n_chars",
            F.when(is_odd, F.col("own.id")).otherwise(F.col("best.id")).alias("keep_id"),
            F.when(is_odd, F.col("own_n")).otherwise(F.col("n") - F.coalesce("others", F.lit(0))).alias("group_size"),
            F.when(is_odd, is_keeper("own")).otherwise(is_keeper("best")).alias("kept"),
        )
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = {
    "op10_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r"""
}
