"""A quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics are counts and ratios of a text's bytes, words and lines, nothing else. They are standardised over the
labelled training rows; cosines of fixed random projections approximate a Gaussian kernel; each partition of the
training rows adds up its normal equations, Spark adds up the partitions, and the driver solves one system of
`features` unknowns. One part of the training rows is kept out of that fit and calibrates the scores: they are summed
on a grid of at most 4,001 values, over which the driver runs pool-adjacent-violators. What reaches the driver has a
fixed size at any number of rows.

Nulls: a null text is empty; a null label is no label; a null id counts as the text "" when folds are made, and is
kept. Repeated rows each get a score; a label that several rows carry counts for each. Without labels of both kinds
every score is the mean label (0.5 without any). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import SPACED, gram_hashes, text_slices, word_table

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate([range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n", b"!", b"$", b"%", b"&", b"*", b"#", b"|", b".", b",", b"@", b"+(", b"=\"'", b"<>{}[]/\\", range(128, 256)], 1):
    for _b in _chars:
        _CLASS[_b] = _k
_CLASSES = int(_CLASS.max()) + 1
N_STATS = _CLASSES + 14
GRID = 1000  # scores are calibrated in steps of 1/GRID between -1.5 and 2.5


def fold(id_col: Column, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def _repeats(sorted_new: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(sorted_new)])
    return total[first[1:]] - total[first[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of N_STATS numbers for each text."""
    out = [np.zeros((0, N_STATS))]
    for lo, hi, raw, at in text_slices(column):
        n, size = hi - lo, np.diff(at).astype(float)
        text = np.repeat(np.arange(n), np.diff(at))
        kinds = np.bincount(text * _CLASSES + _CLASS[raw], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
        words, starts, ends, first = word_table(raw, at, SPACED)
        n_words = np.diff(first).astype(float)
        owner = np.repeat(np.arange(n), np.diff(first))
        per = lambda x: np.bincount(owner, weights=x, minlength=n)
        length = (ends - starts).astype(float)
        same = np.zeros(len(words))
        same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        pairs = gram_hashes(words, 3)
        ok = owner[: len(pairs)] == owner[2:] if len(pairs) else np.zeros(0, bool)

        def distinct(values, owners):
            order = np.lexsort((values, owners))
            v, o = values[order], owners[order]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
            return np.bincount(o[new], minlength=n).astype(float)

        types, triples = distinct(words, owner), distinct(pairs[ok], owner[: len(pairs)][ok])
        n_triples = np.maximum(n_words - 2, 0)
        tail = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        head = raw[starts] if len(starts) else np.zeros(0, np.uint8)
        symbol = _CLASS[tail]
        lines = kinds[:, 5] + 1
        w, b = np.maximum(n_words, 1), np.maximum(size, 1)
        some = [
            np.log1p(size), np.log1p(n_words), per(length) / w, np.sqrt(per(length**2) / w), types / w, per(same) / w, triples / np.maximum(n_triples, 1), np.log1p(lines), np.log1p(size / lines),
            per(((symbol >= 6) & (symbol <= 12)).astype(float)) / w, per((symbol == 13).astype(float)) / w, per(((head >= 65) & (head <= 90)).astype(float)) / w, per((length <= 2).astype(float)) / w, per((length >= 16).astype(float)) / w,
        ]
        out.append(np.concatenate([np.sqrt(kinds / b[:, None]), np.stack(some, 1)], 1))
    return np.concatenate(out)


def _stat_rows(batches):
    for batch in batches:
        x = statistics(batch.column(1)).astype(np.float32)
        ends = np.arange(0, x.size + 1, N_STATS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], names=["id", "x"])


@dataclass
class Kernel:
    """What a task needs to turn statistics into a calibrated score."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.concatenate([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, N_STATS)


def _moments(batches):
    total = np.zeros((3, N_STATS))
    for batch in batches:
        x = _matrix(batch.column(0))
        total += [np.full(N_STATS, len(x)), x.sum(0), (x**2).sum(0)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_STATS), pa.int32()), *map(pa.array, total)], names=["k", "n", "s", "ss"])


def _normal_equations(batches, kernel: Kernel):
    """A partition's sum of z zᵀ and z y: one row (i, values) for each unknown."""
    size = len(kernel.phases) + 1
    total = np.zeros((size, size + 1))
    for batch in batches:
        z = kernel.lifted(_matrix(batch.column(0)))
        total += z.T @ np.concatenate([z, np.asarray(batch.column(1), float)[:, None]], 1)
    ends = np.arange(0, total.size + 1, size + 1, dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))], names=["i", "values"])


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: from sorted values with sums and counts of labels to the points of a rising line."""
    blocks: list[list[float]] = []  # sum of labels, count, sum of x
    for a, b, c in zip(x, total, n):
        blocks.append([b, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


#: Labelled rows whose normal equations a task sums up.
TASK_ROWS = 100_000


def fit(rows: DataFrame, *, features: int, width: float, ridge: float, seed: int, tasks: int) -> Kernel | float:
    """rows: (x, y, calibrate) of the labelled training rows; tasks: the least number of them. A number is returned where both labels aren't there."""
    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return float(next(iter(seen))) if seen else 0.5
    train = rows.where(~F.col("calibrate"))
    m = train.select("x").mapInArrow(_moments, "k int, n double, s double, ss double").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).orderBy("k").toPandas()
    n = np.maximum(m["n"].to_numpy(), 1)
    mean = m["s"].to_numpy() / n
    spread = np.sqrt(np.maximum(m["ss"].to_numpy() / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    kernel = Kernel(mean, np.where(spread > 1e-6, spread, 1.0), rng.normal(0, 1 / (width * np.sqrt(N_STATS)), (N_STATS, features)), rng.uniform(0, 2 * np.pi, features))
    sums = (
        train.select("x", "y")
        .repartition(max(tasks, sum(seen.values()) // TASK_ROWS))
        .mapInArrow(lambda it: _normal_equations(it, kernel), "i int, values array<double>")
        .select("i", F.posexplode("values").alias("j", "v"))
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    total = np.zeros((features + 1, features + 2))
    total[sums["i"], sums["j"]] = sums["v"]
    kernel.weights = np.linalg.solve(total[:, :-1] + ridge * np.eye(features + 1), total[:, -1])

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(kernel.raw(_matrix(batch.column(0))), -1.5, 2.5) * GRID).astype(np.int32)), batch.column(1)], names=["bin", "y"])

    held = rows.where("calibrate")
    bins = (train if held.isEmpty() else held).select("x", "y").mapInArrow(raw, "bin int, y int").groupBy("bin").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()
    # one row of the mean label is spread over the grid, so that no score is certain
    prior = bins["s"].sum() / bins["n"].sum()
    kernel.steps = isotonic(bins["bin"].to_numpy() / GRID, bins["s"].to_numpy() + prior / len(bins), bins["n"].to_numpy() + 1 / len(bins))
    return kernel


def _learnt(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, features: int, width: float, ridge: float, seed: int, tasks: int) -> tuple[DataFrame, Kernel | float]:
    """The statistics (id, x, fold) of docs, and a model of the labelled ones outside fold 0."""
    stats = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = stats.schema["id"].dataType.simpleString()
    stats = written(stats.mapInArrow(_stat_rows, f"id {kind}, x array<float>").withColumn("fold", fold(F.col("id"), folds)), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    rows = written(stats.where("fold <> 0").join(known, "id").select("x", "y", (F.col("fold") == 1).alias("calibrate")), "labelled")
    return stats, fit(rows, features=features, width=width, ridge=ridge, seed=seed, tasks=tasks)


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, features: int = 224, width: float = 0.8, ridge: float = 0.05, seed: int = 17, threshold: float = 0.3, tasks: int = 16
) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted. Rows in fold 0 of `folds` teach nothing."""
    stats, model = _learnt(docs, labels, id_col, text_col, label_col, folds, features, width, ridge, seed, tasks)
    kind = stats.schema["id"].dataType.simpleString()

    def scored(batches):
        for batch in batches:
            x = _matrix(batch.column(2))
            s = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.equal(batch.column(1), 0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return stats.select("id", "fold", "x").mapInArrow(scored, f"id {kind}, held_out boolean, score double, predicted int")


def good_documents(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, features: int = 224, width: float = 0.8, ridge: float = 0.05, seed: int = 17, threshold: float = 0.3, tasks: int = 16
) -> DataFrame:
    """The rows of docs with a score of at least `threshold`, with all their columns; texts are scored as they are read."""
    _, model = _learnt(docs, labels, id_col, text_col, label_col, folds, features, width, ridge, seed, tasks)
    at = docs.columns.index(text_col)

    def good(batches):
        for batch in batches:
            x = statistics(batch.column(at)).astype(np.float32).astype(float)
            s = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(good, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(docs, labels).withColumnRenamed("id", "doc_id")


#: A trained score is not expressible in SQL; tests hold it against held-out labels.
SQL: dict[str, str] = {}
