"""Feature encoders. Each gives (id, vec): one unit vector for each row of an entity table, fitted on the whole table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import md5_number, norm, text_tokens, unit

MISSING, TEXT_DIMS = "__missing__", 128


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, place): a column's distinct values in order, null as a value of its own, numbered from 0."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")
    return df.select(value).distinct().withColumn("place", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))  # one row for each value


def one_hot_places(df: DataFrame, key: str, column: str) -> DataFrame:
    """(id, place): the sparse form of a one-hot column, by a join with its vocabulary."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")
    return df.select(F.col(key).alias("id"), value).join(vocabulary(df, column), "value").select("id", "place")


def _dense(place: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda at: (at == place).cast("double"))


def categorical(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One-hot over each column's sorted values, null as a value of its own; columns side by side.

    Values meet their places in joins; the driver learns how many there are, not which.
    """
    out, parts = df.select(F.col(key).alias("id")), []
    for k, c in enumerate(columns):
        words = vocabulary(df, c)
        size = words.count()
        out = out.join(one_hot_places(df, key, c).withColumnRenamed("place", f"p{k}"), "id")
        parts.append(_dense(F.col(f"p{k}"), max(size, 1)))
    return out.select("id", unit(F.concat(*parts)).alias("vec"))


def _places(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, int]:
    """(id, places) of the ones in `categorical`'s vectors, and those vectors' length."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    out, width = df.select(F.col(key).alias("id"), *[value(c).alias(f"v{k}") for k, c in enumerate(columns)]), 0
    for k, c in enumerate(columns):
        words = vocabulary(df, c)
        out = out.join(words.select(F.col("value").alias(f"v{k}"), (F.col("place") + width).alias(f"p{k}")), f"v{k}")
        width += max(words.count(), 1)
    return out.select("id", F.array(*[f"p{k}" for k in range(len(columns))]).alias("places")), width


def sparse_categorical(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, pos, value): the entries of `categorical` that aren't zero; no vector is made."""
    return _places(df, key, columns)[0].select("id", F.explode("places").alias("pos"), F.lit(len(columns) ** -0.5).alias("value"))


def sparse_early_fusion(df: DataFrame, key: str, categories: list[str], numbers: list[str]) -> DataFrame:
    """(id, pos, value): the entries that aren't zero of `early_fusion` of a categorical and a numerical block."""
    places, width = _places(df, key, categories)
    both = places.join(numerical(df, key, numbers), "id")
    pos = F.concat("places", F.array(*[F.lit(width + k) for k in range(len(numbers))]))
    x = unit(F.concat(F.transform("places", lambda _: F.lit(len(categories) ** -0.5)), "vec"))
    return both.select("id", F.explode(F.arrays_zip(pos.alias("pos"), x.alias("value"))).alias("e")).select("id", "e.pos", "e.value").where("value <> 0")


def numerical(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Median for what isn't a number, then z-scores (population deviation; 1 where it is 0)."""
    number = [F.col(c).try_cast("double").alias(c) for c in columns]
    raw = df.select(F.col(key).alias("id"), *number)
    medians = raw.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"{c}_median") for c in columns])
    filled = raw.crossJoin(F.broadcast(medians)).select("id", *[F.coalesce(c, f"{c}_median").alias(c) for c in columns])  # one row is broadcast
    moments = filled.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_avg"), F.stddev_pop(c).alias(f"{c}_std"))])
    z = [(F.col(c) - F.col(f"{c}_avg")) / F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in columns]
    return filled.crossJoin(F.broadcast(moments)).select("id", unit(F.array(*z)).alias("vec"))


def text_weights(df: DataFrame, key: str, columns: list[str], dims: int = TEXT_DIMS) -> DataFrame:
    """(id, bucket, w): log1p of the count of tokens hashed to each bucket, over the row's norm; only buckets with tokens."""
    tokens = df.select(F.col(key).alias("id"), F.explode(text_tokens(F.concat_ws(" ", *columns))).alias("token"))
    counts = tokens.groupBy("id", F.pmod(md5_number(F.col("token")), F.lit(dims)).cast("int").alias("bucket")).agg(F.log1p(F.count(F.lit(1))).alias("w"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return counts.join(norms, "id").select("id", "bucket", (F.col("w") / F.col("n")).alias("w"))


def text(df: DataFrame, key: str, columns: list[str], dims: int = TEXT_DIMS) -> DataFrame:
    weights = text_weights(df, key, columns, dims).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return df.select(F.col(key).alias("id")).join(weights, "id", "left").select("id", dense.alias("vec"))


def embedding(df: DataFrame, key: str, column: str) -> DataFrame:
    """Given vectors, null as zeros; raises where no row has one, or lengths differ."""
    if not df.schema[column].dataType.simpleString().startswith("array"):
        raise ValueError(f"{column!r} holds no arrays")
    dims = df.agg(F.min(F.size(column)).alias("lo"), F.max(F.when(F.col(column).isNotNull(), F.size(column))).alias("hi"), F.min(F.when(F.col(column).isNotNull(), F.size(column))).alias("least")).first()
    if dims["hi"] is None:
        raise ValueError(f"{column!r} has no vector in any row")
    if dims["hi"] != dims["least"]:
        raise ValueError(f"the vectors of {column!r} differ in length")
    zeros = F.array_repeat(F.lit(0.0), dims["hi"])
    return df.select(F.col(key).alias("id"), unit(F.coalesce(F.col(column).cast("array<double>"), zeros)).alias("vec"))


def blocks(df: DataFrame, key: str, declared: dict[str, list[str]]) -> dict[str, DataFrame]:
    """A table (id, vec) for each modality that is declared, each vector column one of its own."""
    out = {}
    for kind, encode in (("categorical", categorical), ("numerical", numerical), ("text", text)):
        if declared.get(kind):
            out[kind] = encode(df, key, declared[kind])
    for kind in ("embedding", "image"):
        for column in declared.get(kind, []):
            out[f"{kind}:{column}"] = embedding(df, key, column)
    return out


def early_fusion(parts: dict[str, DataFrame]) -> DataFrame:
    """All blocks side by side, normalised again."""
    names = list(parts)
    out = parts[names[0]].withColumnRenamed("vec", "v0")
    for k, name in enumerate(names[1:], 1):
        out = out.join(parts[name].withColumnRenamed("vec", f"v{k}"), "id")
    return out.select("id", unit(F.concat(*[F.col(f"v{k}") for k in range(len(names))])).alias("vec"))


def aligned(catalog: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """A vector for each item of the catalog (item); zeros where there is none."""
    return catalog.join(vectors.withColumnRenamed("id", "item"), "item", "left").select("item", F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)).alias("vec"))


def profiles(seen: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user, vec): the unit mean of the vectors of a user's items. A vector travels whole; rows come sorted by user and are
    added up batch by batch, so no user's rows are gathered."""
    kind = seen.schema["user"].dataType.simpleString()

    def means(batches):
        user, total, n = None, None, 0

        def rows(users, sums, counts):
            mean = sums / counts[:, None]
            size = np.sqrt((mean**2).sum(1, keepdims=True))
            mean = np.divide(mean, size, out=np.zeros_like(mean), where=size > 0)
            return pa.RecordBatch.from_arrays([users, pa.ListArray.from_arrays(pa.array(np.arange(len(mean) + 1) * mean.shape[1], pa.int32()), pa.array(mean.ravel()))], names=["user", "vec"])

        for batch in batches:
            if not batch.num_rows:
                continue
            users, vec = batch.column(0), batch.column(1)
            x = np.asarray(vec.flatten(), float).reshape(len(vec), -1)
            change = np.ones(len(users), bool)
            change[1:] = np.asarray(pc.not_equal(users[1:], users[:-1]))
            first = np.flatnonzero(change)
            sums, counts, users = np.add.reduceat(x, first), np.diff(np.append(first, len(x))), users.take(pa.array(first))
            if user is not None:
                if users[0].as_py() == user[0].as_py():
                    sums[0] += total[0]
                    counts[0] += n[0]
                else:
                    yield rows(user, total, n)
            if len(users) > 1:
                yield rows(users[:-1], sums[:-1], counts[:-1])
            user, total, n = users[-1:], sums[-1:], counts[-1:]
        if user is not None:
            yield rows(user, total, n)

    each = seen.where("user is not null").join(vectors.withColumnRenamed("id", "item"), "item").select("user", "vec")
    return each.repartition("user").sortWithinPartitions("user").mapInArrow(means, f"user {kind}, vec array<double>")


def active(vectors: DataFrame) -> DataFrame:
    return vectors.where(norm(F.col("vec")) > 0)
