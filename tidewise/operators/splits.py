"""Holdout splits. Each returns the interactions with a boolean column `held`; train is NOT held, test is held."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import md5_order

SHARE = 0.2


def _first_of_two(user: str, by: list):
    """Whether a row is its user's first in order and another follows: one sort, and no user's rows are held to be counted."""
    w = Window.partitionBy(user).orderBy(*by)
    return (F.row_number().over(w) == 1) & F.lead(F.lit(1)).over(w).isNotNull()


def leave_last_out(df: DataFrame, user: str, order: list[str]) -> DataFrame:
    """The last row of each user with two rows at least. order: columns, the time first; a null time counts as last."""
    by = [F.col(order[0]).desc_nulls_first(), *[F.col(c).desc() for c in order[1:]]]
    return df.withColumn("held", _first_of_two(user, by))


def leave_random_out(df: DataFrame, user: str, keys: list[str], seed: int = 42) -> DataFrame:
    """One row of each user with two rows at least, chosen by a hash of the seed and the row's keys."""
    by = [md5_order(seed, F.col(user), *[F.col(k) for k in keys]), *[F.col(k) for k in keys]]
    return df.repartition(user).withColumn("held", _first_of_two(user, by))  # dealt first, so the hashes aren't shuffled


def cold_users(df: DataFrame, user: str, seed: int = 42, share: float = SHARE) -> DataFrame:
    """(user) of the users held out as a whole: the first of all in the order of a seeded hash.

    TakeOrderedAndProject keeps the wanted number on each task, so there is no global sort.
    """
    users = df.select(user).distinct()
    n = users.count()
    take = 0 if n < 2 else min(n - 1, max(1, round(n * share)))  # round() is half-even
    return users.orderBy(md5_order(seed, F.col(user)), user).limit(take)


def hold_users_out(df: DataFrame, user: str, seed: int = 42, share: float = SHARE) -> DataFrame:
    cold = cold_users(df, user, seed, share).withColumn("held", F.lit(True))
    return df.join(cold, user, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def global_cut(df: DataFrame, timestamp: str, share: float = SHARE):
    """The timestamp from which rows are held out: at position int(n * (1 - share)) in time order, ties kept together.

    The position is found by counts per day, then inside one day, so no sort of all rows is made.
    """
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(timestamp).isNull()).alias("nulls"), F.min(timestamp).alias("lo"), F.max(timestamp).alias("hi")).first()
    if seen["nulls"] or not seen["n"] or seen["lo"] == seen["hi"]:
        raise ValueError("a global time split needs timestamps in every row, and two different ones at least")
    at = min(seen["n"] - 1, max(1, int(seen["n"] * (1.0 - share))))
    days = df.groupBy(F.to_date(timestamp).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()  # one row for each day
    for day in days:
        if at < day["n"]:
            break
        at -= day["n"]
    times = df.where(F.to_date(timestamp) == F.lit(day["day"])).groupBy(timestamp).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy(timestamp).rowsBetween(Window.unboundedPreceding, 0))
    cut = times.withColumn("up_to", running).where(F.col("up_to") > at).agg(F.min(timestamp)).first()[0]
    if cut == seen["lo"]:
        cut = df.where(F.col(timestamp) > F.lit(cut)).agg(F.min(timestamp)).first()[0]
    return cut


def after_global_cut(df: DataFrame, timestamp: str, share: float = SHARE) -> DataFrame:
    return df.withColumn("held", F.col(timestamp) >= F.lit(global_cut(df, timestamp, share)))


def split(df: DataFrame, how: str, *, user: str, timestamp: str | None, keys: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a strategy's name; the columns stay."""
    if how == "temporal":
        marked = leave_last_out(df, user, [*([timestamp] if timestamp else []), *keys])
    elif how == "random":
        marked = leave_random_out(df, user, keys, seed)
    elif how == "cold_start":
        marked = hold_users_out(df, user, seed)
    elif how == "global_temporal":
        if not timestamp:
            raise ValueError("a global time split needs a timestamp column")
        marked = after_global_cut(df, timestamp)
    else:
        raise ValueError(f"no split {how!r}; there are temporal, random, cold_start and global_temporal")
    return marked.where("not held").drop("held"), marked.where("held").drop("held")


def three_way(df: DataFrame, how: str, **kwargs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, test): the same strategy twice."""
    rest, test = split(df, how, **kwargs)
    train, validation = split(rest, how, **kwargs)
    return train, validation, test


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that both have."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")


def check_windows(parts: list[tuple[str, DataFrame]], timestamp: str) -> None:
    """Each part must begin after the one before it ends."""
    last = None
    for name, df in parts:
        lo, hi = df.agg(F.min(timestamp), F.max(timestamp)).first()
        if lo is None:
            continue
        if last is not None and lo <= last:
            raise ValueError(f"{name} must begin after the part before it ends")
        last = hi
