"""Rank fusion: weighted reciprocal ranks, and weights from a small logistic regression on validation hits."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Folder, shared_folder
from .history import top_k

RANK_CONSTANT, FUSED = 60, "RankFusion"
#: Different rows of ranks and label that the driver fits weights to.
PATTERNS = 1 << 16


def reciprocal_rank_fusion(recs: DataFrame, k: int, weights: dict[str, float] | None = None, constant: int = RANK_CONSTANT, digits: int | None = None) -> DataFrame:
    """(user, item, rank, score, model): sum over models of weight / (constant + rank); a model without a weight has 1."""
    weight = F.lit(1.0)
    for model, value in (weights or {}).items():
        weight = F.when(F.col("model") == model, F.lit(float(value))).otherwise(weight)
    total = F.sum(weight / (constant + F.col("rank")))
    fused = recs.groupBy("user", "item").agg((F.round(total, digits) if digits else total).alias("score"))
    return top_k(fused, k).select("user", "item", "rank", "score", F.lit(FUSED).alias("model"))


def stacking_features(recs: DataFrame, truth: DataFrame, models: list[str], constant: int = RANK_CONSTANT) -> DataFrame:
    """(user, item, one column for each model, label): 1 / (constant + rank) or 0, for users of the truth."""
    users = truth.select("user").distinct()
    rows = recs.join(users, "user", "left_semi").groupBy("user", "item").pivot("model", models).agg(F.max(1.0 / (constant + F.col("rank")))).fillna(0.0)
    hits = truth.select("user", "item").distinct().withColumn("label", F.lit(1.0))
    return rows.join(hits, ["user", "item"], "left").fillna(0.0, ["label"])


def logistic_weights(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
    """Full-batch descent from zero, the intercept last and regularised too. times: how often each row counts."""
    x = np.hstack([x, np.ones((len(x), 1))])
    times = np.ones(len(x)) if times is None else times
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= rate * (_slope(x, y, times, w) / times.sum() + ridge * w)
    return w


def _slope(x: np.ndarray, y: np.ndarray, times: np.ndarray, w: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (times * (p - y))


def _distributed_weights(rows: DataFrame, total: int, steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
    """logistic_weights over a kept table (features, label, times) that no one task or driver holds: a job a step."""
    width = len(rows.columns) - 1
    w = np.zeros(width)
    for _ in range(steps):

        def added(batches, w=w):
            sum_of = np.zeros(width)
            for b in batches:
                *x, y, times = (c.to_numpy() for c in b.columns)
                sum_of += _slope(np.stack([*x, np.ones(len(y))], 1), y, times.astype(float), w)
            yield pa.RecordBatch.from_arrays([pa.array([sum_of])], names=["g"])

        parts = rows.mapInArrow(added, "g array<double>").collect()  # one short row from each task
        w = w - rate * (sum((np.array(r["g"]) for r in parts), np.zeros(width)) / total + ridge * w)
    return w


def fit_weights(recs: DataFrame, truth: DataFrame, models: list[str]) -> dict[str, float]:
    """A weight for each model, summing to 1; all 1.0 where there is one model or no truth.

    All users of the truth count. Rows with equal ranks and label are one pattern that is counted; with PATTERNS of them at
    most the driver fits them, with more the tasks do.
    """
    if len(models) < 2 or truth.isEmpty():
        return dict.fromkeys(models, 1.0)
    spark = recs.sparkSession
    columns = [f"x{k}" for k in range(len(models))]
    rows = stacking_features(recs, truth, models).select(*[F.col(f"`{m}`").alias(c) for m, c in zip(models, columns)], "label")
    folder, name = Folder(spark, f"{shared_folder(spark)}/tidewise-fusion"), uuid.uuid4().hex
    kept = folder.save(rows.groupBy(*columns, "label").agg(F.count(F.lit(1)).alias("times")), name)
    try:
        n, total = kept.agg(F.count(F.lit(1)), F.sum("times")).first()
        if not n:
            return dict.fromkeys(models, 1.0)
        if n > PATTERNS:
            w = _distributed_weights(kept, total)
        else:
            some = kept.orderBy(*columns, "label").toPandas()
            w = logistic_weights(some[columns].to_numpy(), some["label"].to_numpy(), some["times"].to_numpy(float))
    finally:
        folder.delete(name)
    w = np.maximum(w[: len(models)], 0)
    w = w / w.sum() if w.sum() > 0 else np.full(len(models), 1 / len(models))
    return dict(zip(models, map(float, w)))
