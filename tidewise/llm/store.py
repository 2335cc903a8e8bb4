"""Shared storage of intermediate tables, and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a join may broadcast for a pre-filter; a bucket number has 8 bytes, so this is 8 MB at most.
BUCKETS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the folder that checkpoints were set to.

    Where neither is there, a local session (tests) gets a new folder of its own; a cluster must name one.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewise-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewise/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends here, and a lost executor loses nothing of it."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def moved(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder; its new parent is made if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(new).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(new).getParent())
    if not system.rename(path(old), path(new)):
        raise OSError(f"{old} can't be renamed to {new}")


def lower_ascii(c):
    """A-Z to a-z; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(docs: DataFrame, name: str) -> str:
    """A column name for the library's own use that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with a number of each row's id and text, and its column's name: rows of one id, or of none, are told apart."""
    key = spare(docs, "row_key")
    return docs.withColumn(key, F.xxhash64(F.col(id_col), F.lit("/"), F.col(text_col))), key


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is in gone (id), which need not be distinct; null ids stay.

    At most BUCKETS hash numbers of the ids in gone are broadcast. Rows with other numbers pass as they are read; only
    the rest is shuffled for the exact anti-join. docs may have columns of any name.
    """
    slot, out = spare(docs, "slot"), spare(docs, "gone")
    gone = gone.select(F.col("id").alias(out)).where(F.col(out).isNotNull()).distinct()
    number = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(BUCKETS))
    numbers = F.broadcast(gone.select(number(out).alias(slot)).distinct())
    marked = docs.withColumn(slot, number(id_col))
    rest = marked.join(numbers, slot, "left_semi")
    rest = rest.join(gone, F.col(id_col) == F.col(out), "left_anti")
    return marked.join(numbers, slot, "left_anti").drop(slot).unionByName(rest.select(*docs.columns))
