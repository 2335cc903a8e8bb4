"""Histories, popularity, sampling and top-k without what a user has seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import md5_number

#: Places of the popularity ranking that are broadcast, and parts of each place beyond.
HEAD, PARTS = 1000, 32


def seen_pairs(df: DataFrame) -> DataFrame:
    """Distinct (user, item)."""
    return df.select("user", "item").distinct()


def popularity(df: DataFrame, times: str | None = None) -> DataFrame:
    """(item, n, score): all events count, repeats too; score = n / the largest n. times: a column with each row's events, if
    they were counted before."""
    counts = df.groupBy("item").agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("item", "n", (F.col("n") / F.col("most")).alias("score"))  # one row is broadcast


def heavy_hitters(df: DataFrame, most: int) -> DataFrame:
    """(item, n) of the most frequent items, ties by id; counts are exact, then cut."""
    return df.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("item").cast("string")).limit(most)


def ranked(df: DataFrame, by: Column, within: list[str], tie: str = "item") -> Column:
    """1, 2, ... by falling score, ties by the item as a string."""
    return F.row_number().over(Window.partitionBy(*within).orderBy(by.desc(), F.col(tie).cast("string")))


def top_k(scores: DataFrame, k: int, within: tuple[str, ...] = ("user",)) -> DataFrame:
    """The k best scores of each group with their rank; NaN and minus infinity are no scores. Spark cuts each task's groups
    to k rows before the shuffle."""
    scores = scores.where(~F.isnan("score") & (F.col("score") > float("-inf")))
    return scores.withColumn("rank", ranked(scores, F.col("score"), list(within))).where(F.col("rank") <= k)


def without_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    return candidates.join(seen, ["user", "item"], "left_anti")


def popular_unseen(users: DataFrame, counts: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """(user, item, score, rank): the k most popular items that a user hasn't seen.

    A user with s seen items finds k unseen ones among the first k + s of the ranking. The first HEAD places are one row,
    broadcast as an array, from which shorter histories are taken away as sets; the few other users meet the first k + s
    places by their number, each place dealt out in PARTS. Places are numbered by counts, so no task sorts the catalog.
    """
    order = [F.desc("n"), F.col("item").cast("string")]
    named = counts.select("n", "item", "score")
    top = named.orderBy(*order).limit(HEAD)
    head = top.agg(F.collect_list(F.struct("n", F.col("item").cast("string").alias("name"), "item")).alias("all"))
    sorted_head = F.array_sort("all", lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1)).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    head = head.select(F.transform(sorted_head, lambda x: x["item"]).alias("head"))
    need = users.select("user").distinct().join(seen.groupBy("user").agg(F.count(F.lit(1)).alias("s")), "user", "left").select("user", (F.coalesce("s", F.lit(0)) + k).alias("need"))
    own = seen.join(need.where(F.col("need") <= HEAD).select("user"), "user", "left_semi").groupBy("user").agg(F.collect_set("item").alias("own"))
    short = need.where(F.col("need") <= HEAD).join(own, "user", "left").crossJoin(F.broadcast(head))
    first = F.slice(F.col("head"), F.lit(1), F.col("need").cast("int"))
    left = F.slice(F.when(F.col("own").isNull(), first).otherwise(F.array_except(first, F.col("own"))), 1, k)
    places = short.select("user", F.posexplode(left).alias("rank", "item"))
    found = places.join(F.broadcast(top.select("item", "score")), "item").select("user", "item", "score", (F.col("rank") + 1).alias("rank"))  # HEAD rows
    long = need.where(F.col("need") > HEAD)
    levels = named.groupBy("n").agg(F.count(F.lit(1)).alias("of_n"))
    levels = levels.select("n", (F.sum("of_n").over(Window.orderBy(F.desc("n"))) - F.col("of_n")).alias("before"))  # one row for each count
    place = named.join(levels, "n").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("n").orderBy(F.col("item").cast("string"))))
    place = place.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    some = long.select("user", F.pmod(F.xxhash64("user"), F.lit(PARTS)).cast("int").alias("part"), F.explode(F.sequence(F.lit(1), F.col("need").cast("int"))).alias("place"))
    return found.unionByName(top_k(without_seen(some.join(place, ["place", "part"]).select("user", "item", "score"), seen), k))


def history_lists(df: DataFrame) -> DataFrame:
    """(user, n_items, items): the distinct items of each user, sorted."""
    return seen_pairs(df).groupBy("user").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))


def bucket(user: Column, buckets: int) -> Column:
    return F.pmod(md5_number(user), F.lit(buckets)).cast("int")


def sampled_users(df: DataFrame, rate: float, cap: int, order: list[Column]) -> DataFrame:
    """Rows of the users that a hash puts under `rate`, at most `cap` of each, the newest."""
    some = df.where(md5_number(F.lit("sample"), F.col("user")) < F.lit(int(rate * 2**32)))
    return some.withColumn("_r", F.row_number().over(Window.partitionBy("user").orderBy(*order))).where(F.col("_r") <= cap).drop("_r")
