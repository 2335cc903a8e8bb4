"""Ranking metrics, averaged over the users of the truth; users without recommendations count as zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("recall", "precision", "hit_rate", "mrr", "ndcg", "map", "auc")
_ALIASES = {"hitrate": "hit_rate", "hit": "hit_rate"}


def metric(name: str) -> tuple[str, int]:
    """("ndcg", 10) of "NDCG@10"."""
    kind, _, cut = name.strip().lower().partition("@")
    kind = _ALIASES.get(kind, kind)
    if kind not in NAMES or not cut.isdigit() or int(cut) < 1:
        raise ValueError(f"not a metric: {name!r}; use one of {', '.join(NAMES)} with a cut-off, like recall@10")
    return kind, int(cut)


def normal_name(name: str) -> str:
    return "{}@{}".format(*metric(name))


def _by_user(p, h, r, first, dcg, precisions, above) -> dict:
    """The metrics of one list: rows, hits, relevant items, rank of the first hit, gains, precisions at hits, misses above hits."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(r, p), F.lit(1)).cast("int")), F.lit(0.0), lambda s, n: s + 1 / F.log2(n + 1.0))
    misses = p - h
    return {
        "recall": h / r,
        "precision": F.when(p > 0, h / p).otherwise(0.0),
        "hit_rate": F.when(h > 0, 1.0).otherwise(0.0),
        "mrr": F.coalesce(1 / first, F.lit(0.0)),
        "ndcg": F.when(p > 0, dcg / ideal).otherwise(0.0),
        "map": precisions / r,
        "auc": F.when(h == 0, 0.0).when(misses == 0, 1.0).otherwise((h * misses - above) / (h * misses)),
    }


def _sums(k: int) -> dict:
    """What the metrics at k need of a list's rows (rank, hit, and the running hits and misses)."""
    cut = F.col("rank") <= k
    hit = cut & (F.col("hit") == 1)
    return {
        "p": F.sum(F.when(cut, 1).otherwise(0)),
        "h": F.sum(F.when(hit, 1).otherwise(0)),
        "first": F.min(F.when(hit, F.col("rank"))),
        "dcg": F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)),
        "precisions": F.sum(F.when(hit, F.col("hits") / F.col("rank")).otherwise(0.0)),
        "above": F.sum(F.when(hit, F.col("misses")).otherwise(0)),
    }


def _marked(recs: DataFrame, truth: DataFrame, *columns: str) -> DataFrame:
    """(model, user, rank, r, hit, hits, misses) of recs. A user's relevant items are one array, so lists that are dealt by user stay where they are. No table of users is broadcast, however few bytes it has."""
    relevant = truth.groupBy("user").agg(F.collect_set("item").alias("relevant"))
    hit = F.coalesce(F.array_contains("relevant", F.col("item")).cast("int"), F.lit(0))
    rows = recs.join(relevant.hint("merge"), "user", "left").select("model", "user", "rank", F.size("relevant").alias("r"), hit.alias("hit"), *columns)
    run = Window.partitionBy("model", "user").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("hits", F.sum("hit").over(run)).withColumn("misses", F.sum(1 - F.col("hit")).over(run))


def user_metrics(recs: DataFrame, truth: DataFrame, k: int, models: list[str] | None = None) -> DataFrame:
    """One row for each model and user of the truth, with every metric at k.

    recs: (user, item, rank, model); truth: (user, item). models: their names, if known; else recs are read once more for them.
    A user's list has k rows at most, so the windows are small.
    """
    sizes = truth.groupBy("user").agg(F.countDistinct("item").alias("r"))
    per = _marked(recs.where(F.col("rank") <= k), truth).groupBy("model", "user").agg(*[c.alias(n) for n, c in _sums(k).items()])
    named = sizes.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model")) if models else sizes.crossJoin(F.broadcast(recs.select("model").distinct()))  # a row for each model
    x = named.join(per.hint("merge"), ["model", "user"], "left").fillna(0, ["p", "h", "dcg", "precisions", "above"])
    names = ("p", "h", "r", "first", "dcg", "precisions", "above")
    return x.select("model", "user", *[c.alias(n) for n, c in _by_user(*map(F.col, names)).items()])


def coverage(recs: DataFrame, catalog_size: int) -> DataFrame:
    """(model, coverage): distinct items at any rank over the catalog's size."""
    return recs.groupBy("model").agg((F.countDistinct("item") / F.lit(float(catalog_size)) if catalog_size else F.lit(0.0)).alias("coverage"))


def evaluate(recs: DataFrame, truth: DataFrame, metrics: list[str], catalog_size: int) -> DataFrame:
    """The leaderboard: a row for each model, a column for each metric, and coverage; best first by the first metric.

    recs are read once: each list's first row carries its metrics at all cut-offs, and the sums over users are taken together
    with the distinct items. Without any truth the metrics are null.
    """
    wanted = list(dict.fromkeys(metric(m) for m in metrics))
    whole = Window.partitionBy("model", "user").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(Window.partitionBy("model", "user").orderBy("rank")) == 1
    rows, values = _marked(recs, truth, "item").withColumn("counts", first & (F.col("r") > 0)), {}
    for k in sorted({k for _, k in wanted}):
        rows = rows.select("*", *[c.over(whole).alias(f"{n}_{k}") for n, c in _sums(k).items()])
        at = lambda n: F.col("r" if n == "r" else f"{n}_{k}")  # noqa: E731, B023
        found = _by_user(*map(at, ("p", "h", "r", "first", "dcg", "precisions", "above")))
        values |= {(kind, k): F.when(F.col("counts"), found[kind]) for kind, cut in wanted if cut == k}
    users = truth.agg(F.countDistinct("user").alias("users"))
    names = {(kind, k): f"{kind}@{k}" for kind, k in wanted}
    rows = rows.select("model", "item", *[v.alias(names[w]) for w, v in values.items()])
    share = F.countDistinct("item") / F.lit(float(catalog_size)) if catalog_size else F.lit(0.0)
    sums = rows.groupBy("model").agg(share.alias("coverage"), *[F.coalesce(F.sum(f"`{n}`"), F.lit(0.0)).alias(n) for n in names.values()]).crossJoin(F.broadcast(users))  # one row
    order = [names[w] for w in wanted]
    return sums.select("model", *[F.try_divide(F.col(f"`{n}`"), "users").alias(n) for n in order], "coverage").orderBy(F.desc(f"`{order[0]}`"), "model")


def over_seeds(runs: DataFrame, names: list[str]) -> DataFrame:
    """(model, seeds, <name>_mean, <name>_deviation) of runs (model, seed, <name>, ...); the deviation is that of all runs."""
    values = [x for n in names for x in (F.avg(f"`{n}`").alias(f"{n}_mean"), F.stddev_pop(f"`{n}`").alias(f"{n}_deviation"))]
    return runs.groupBy("model").agg(F.countDistinct("seed").alias("seeds"), *values)
