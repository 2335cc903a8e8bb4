"""Files in the folder that driver and executors share, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that checkpoints were set to. Where neither is there, a local session gets a
    new folder of its own; a cluster must name one."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewise-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, Spark removes the shuffle files of a query as soon as it has ended, and not some time after, and broadcasts no
    table that it wasn't told to: one below its threshold of bytes on disk is many times as large in the driver's memory."""
    inside = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in inside}
    for name, value in inside.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Kept:
    """Writes tables that are read several times to the shared folder; what was shuffled for them leaves the disk."""

    def __call__(self, df: DataFrame) -> DataFrame:
        with shuffles_removed(df.sparkSession):
            return self._folder(df.sparkSession).save(df, uuid.uuid4().hex)

    def together(self, parts: Iterable[DataFrame]) -> DataFrame:
        """One table of parts that are made and written one after the other. It is read as one scan, so plans over it don't
        grow with the number of parts."""
        name, some = uuid.uuid4().hex, None
        for k, part in enumerate(parts):
            with shuffles_removed(part.sparkSession):
                some = self._folder(part.sparkSession).save(part, f"{name}/{k}")
        return some.sparkSession.read.schema(some.schema).option("recursiveFileLookup", "true").parquet(f"{self._folder(some.sparkSession).path}/{name}")

    def _folder(self, spark: SparkSession) -> Folder:
        return Folder(spark, f"{shared_folder(spark)}/tidewise-kept")


def removed(df: DataFrame) -> None:
    """Deletes the folders of tables that Folder.save() wrote, once nothing reads df any more."""
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        above, _, name = at.rpartition("/")
        Folder(df.sparkSession, above).delete(name)


class Folder:
    """A folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole text at once: written beside, then renamed over the old one."""
        above, _, last = name.rpartition("/")
        beside = f"{above}/.{last}-{uuid.uuid4().hex}".lstrip("/")
        self._put(beside, text, False)
        old = f"{beside}-old"
        if self.exists(name):
            self._fs.rename(self._at(name), self._at(old))
        if not self._fs.rename(self._at(beside), self._at(name)):
            raise OSError(f"{self.path}/{name} can't be written")
        self._fs.delete(self._at(old), False)

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        self._fs.mkdirs(self._at(""))
        stream = self._fs.create(self._at(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False where there is one already."""
        try:
            self._put(name, text, False)
            return True
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        return self._jvm.java.lang.System.currentTimeMillis() / 1000 - self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def rename(self, old: str, new: str) -> None:
        if self.exists(new) or not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{self.path}/{old} can't be renamed to {new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def files(self, name: str) -> list[list]:
        """Names and lengths of the data files of a folder, in order."""
        return sorted([s.getPath().getName(), s.getLen()] for s in self._fs.listStatus(self._at(name)) if s.isFile() and s.getPath().getName().startswith("part-")) if self.exists(name) else []

    def table(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(f"{self.path}/{name}")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.table(name, df.schema)
