"""Tables from files and frames, conversion to Parquet, fingerprints, directory discovery, and result sinks."""

from __future__ import annotations

import csv
import hashlib
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".tsv": "tsv", ".txt": "txt", ".jsonl": "json", ".ndjson": "json"}
#: How much of a text file decides on its delimiter, and among which.
SNIFFED, DELIMITERS = 8192, ",\t|;"


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    head = "\n".join(r[0] for r in spark.read.text(path).limit(50).collect())[:SNIFFED]
    try:
        return csv.Sniffer().sniff(head, delimiters=DELIMITERS).delimiter
    except csv.Error as e:
        raise ValueError(f"no delimiter found in {path}; pass delimiter explicitly") from e


def load(spark: SparkSession, value: DataFrame | pd.DataFrame | str | Path, delimiter: str | None = None) -> DataFrame:
    """A Spark or pandas frame, or the file or folder at a path, by its suffix."""
    if isinstance(value, DataFrame):
        return value
    if isinstance(value, pd.DataFrame):
        return spark.createDataFrame(value)
    path = str(value)
    kind = SUFFIXES.get(Path(path.rstrip("/")).suffix.lower())
    if kind is None:
        raise ValueError(f"unknown kind of file: {path}; known suffixes are {', '.join(SUFFIXES)}")
    if delimiter is not None and len(delimiter) != 1:
        raise ValueError("a delimiter is one character")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.json(path)
    sep = delimiter or {"csv": ",", "tsv": "\t"}.get(kind) or sniff_delimiter(spark, path)
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep)


def convert(spark: SparkSession, source: str | Path, output: str | Path | None = None, *, delimiter: str | None = None, compression: str = "zstd", overwrite: bool = False) -> str:
    """Writes a table as Parquet beside the source, or at output; an existing one stays unless overwrite."""
    source = str(source)
    if Path(source.rstrip("/")).suffix.lower() not in SUFFIXES:
        raise ValueError(f"unknown kind of file: {source}; known suffixes are {', '.join(SUFFIXES)}")
    target = str(output or Path(source).with_suffix(".parquet"))
    if target == source or (exists(spark, target) and not overwrite):
        return target
    _replace(load(spark, source, delimiter), target, compression)
    return target


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _replace(df: DataFrame, target: str, compression: str) -> None:
    """Written under another name first, so a reader never finds half a table."""
    spark, other = df.sparkSession, f"{target}.{uuid.uuid4().hex}.tmp"
    df.write.option("compression", compression).parquet(other)
    fs, to = _fs(spark, target)
    old = _fs(spark, f"{target}.{uuid.uuid4().hex}.old")[1]
    had = fs.exists(to) and fs.rename(to, old)
    if not fs.rename(_fs(spark, other)[1], to):
        if had:  # the table that was there comes back
            fs.rename(old, to)
        raise OSError(f"{other} can't be renamed to {target}")
    if had:
        fs.delete(old, True)


def write_recommendations(recs: DataFrame, path: str | Path, compression: str = "zstd") -> str:
    """The recommendations as one Parquet table, or with a path that ends in .csv as CSV files; raises where there are none."""
    if recs.isEmpty():
        raise ValueError("no recommendations were made")
    if str(path).endswith(".csv"):
        recs.write.mode("overwrite").option("header", True).csv(str(path))
        return str(path)
    _replace(recs, str(path), compression)
    return str(path)


def frame_fingerprint(df: DataFrame) -> str:
    """Names, types, row count, and sums of row hashes that don't depend on the rows' order."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(c) for c in df.columns]) if df.columns else F.lit(0)
    seen = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(20,0)"))).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{seen[0]}|{seen[1]}|{seen[2]}".encode()).hexdigest()


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """Of a file, or of a folder's files in the order of their names: their bytes' digest, made by tasks."""
    digests = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("d")).orderBy("path").toPandas()["d"]  # one row for each file
    return hashlib.sha256("|".join(digests).encode()).hexdigest()


def listing_key(spark: SparkSession, path: str) -> str:
    """A digest of the names, lengths and times of a file, or of a folder's files; nothing of them is read."""
    fs, p = _fs(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        s = files.next()
        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


class Cache:
    """Tables kept as Parquet under a folder: a path's by its files' names, lengths and times, a frame's by its content."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.folder = spark, str(folder)

    def table(self, value, name: str) -> DataFrame:
        of_path = isinstance(value, (str, Path))
        df = None if of_path else load(self.spark, value)
        key = listing_key(self.spark, str(value)) if of_path else frame_fingerprint(df)
        path = f"{self.folder}/{name}-{key[:16]}.parquet"
        if not exists(self.spark, path):
            _replace(load(self.spark, value) if of_path else df, path, "zstd")
        return self.spark.read.parquet(path)


# How tables and columns are recognised by name.
USER_NAMES = ("user_id", "userid", "user", "uid", "user_id_str")
ITEM_NAMES = ("item_id", "itemid", "item", "iid", "movie_id", "movieid", "product_id", "productid", "book_id", "bookid")
TIME_NAMES = ("timestamp", "time", "ts", "datetime", "date", "created_at")
LABEL_NAMES = ("rating", "label", "score", "click", "clicked", "purchase", "purchased")
TABLE_NAMES = {
    "interactions": ("interactions", "interaction", "ratings", "rating", "events", "clicks", "train"),
    "users": ("users", "user"),
    "items": ("items", "item", "movies", "products", "books"),
}
VECTOR_NAMES = ("embedding", "vector", "feature", "emb", "vec")
#: A string column is text beyond this mean length or number of distinct values, over the first rows.
TEXT_LENGTH, TEXT_DISTINCT, LOOKED_AT = 12, 200, 500


@dataclass
class Discovered:
    interactions: DataFrame
    users: DataFrame | None
    items: DataFrame | None
    user: str
    item: str
    timestamp: str | None
    label: str | None
    modalities: dict[str, Any] = field(default_factory=dict)


def role(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first of the names that a column has, in any case."""
    by_name = {c.lower(): c for c in reversed(columns)}
    return next((by_name[n] for n in names if n in by_name), None)


def modality(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType) or any(h in column.lower() for h in VECTOR_NAMES):
        return "embedding"
    if isinstance(kind, T.NumericType):
        return "numerical"
    value = df.select(F.col(column).cast("string").alias("v")).where("v is not null").limit(LOOKED_AT)
    seen = value.agg(F.avg(F.length("v")).alias("length"), F.countDistinct("v").alias("distinct")).first()
    return "text" if (seen["length"] or 0) > TEXT_LENGTH or seen["distinct"] > TEXT_DISTINCT else "categorical"


def discover(spark: SparkSession, directory: str | Path) -> Discovered:
    """Tables, column roles and item modalities of a folder, by names and types."""
    root = Path(directory)
    if not root.is_dir():
        raise FileNotFoundError(f"no such folder: {root}")
    found: dict[str, Path] = {}
    for path in sorted(root.iterdir()):
        if path.suffix.lower() not in SUFFIXES:
            continue
        kind = next((k for k, names in TABLE_NAMES.items() if k not in found and any(n in path.stem.lower() for n in names)), None)
        if kind:
            found[kind] = path
    if "interactions" not in found:
        raise ValueError(f"{root} has no table of interactions; its file's name holds one of {', '.join(TABLE_NAMES['interactions'])}")
    tables = {k: load(spark, p) for k, p in found.items()}
    columns = tables["interactions"].columns
    user, item = role(columns, USER_NAMES), role(columns, ITEM_NAMES)
    if not user or not item:
        raise ValueError(f"no {'user' if not user else 'item'} column among {columns}")
    modalities: dict[str, Any] = {}
    if "items" in tables:
        kinds: dict[str, list[str]] = {}
        for c in tables["items"].columns:
            if c != item:
                kinds.setdefault(modality(tables["items"], c), []).append(c)
        modalities = {"item": kinds} if kinds else {}
    return Discovered(tables["interactions"], tables.get("users"), tables.get("items"), user, item, role(columns, TIME_NAMES), role(columns, LABEL_NAMES), modalities)
