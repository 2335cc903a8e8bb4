"""Histories on disk in buckets of users, so that a lookup reads only the buckets it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import bucket, seen_pairs
from .tables import exists, frame_fingerprint


def build(interactions: DataFrame, folder: str, buckets: int = 256) -> str:
    """Writes the distinct (user, item) pairs under folder, in one partition for each bucket; the same content is reused.

    Rows are dealt by user inside a bucket's number before the write, so a task writes few files and a hot bucket is
    spread over tasks by Spark's rebalancing.
    """
    pairs = seen_pairs(interactions).withColumn("bucket", bucket(F.col("user"), buckets))
    path = f"{folder.rstrip('/')}/history-{buckets}-{frame_fingerprint(seen_pairs(interactions))[:16]}"
    if not exists(interactions.sparkSession, f"{path}/_SUCCESS"):
        pairs.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
    return path


def lookup(spark: SparkSession, path: str, users: DataFrame) -> DataFrame:
    """(user, item) of the users in (user), read from the partitions of their buckets alone."""
    buckets = int(path.rsplit("history-", 1)[1].split("-")[0])
    wanted = users.select("user").distinct().withColumn("bucket", bucket(F.col("user"), buckets))
    some = [r[0] for r in wanted.select("bucket").distinct().collect()]  # `buckets` numbers at most
    return spark.read.parquet(path).where(F.col("bucket").isin(some)).join(wanted, ["bucket", "user"], "left_semi").select("user", "item")
