"""Popularity and histories that follow a stream of interactions (an extension; refitting needs no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import bucket


def popularity_stream(events: DataFrame, path: str, checkpoint: str):
    """Writes each batch's changed counts per item to a table; a batch that runs again replaces itself. Returns the started query."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts = events.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def popularity_table(spark, path: str) -> DataFrame:
    """(item, n) after all batches: an item's count only grows."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").groupBy("item").agg(F.max("n").alias("n"))


def history_stream(events: DataFrame, path: str, checkpoint: str, buckets: int = 256):
    """Appends each batch's distinct (user, item) pairs to a table in buckets; a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        pairs = batch.select("user", "item").distinct().withColumn("bucket", bucket(F.col("user"), buckets))
        pairs.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_table(spark, path: str) -> DataFrame:
    """The distinct pairs of all batches."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").select("user", "item").distinct()
