"""Dynamic programming of the personal-data field and normal equations of the quality model, against plain versions."""

import itertools

import numpy as np
import pytest

from tidewise.llm import pii, quality

KINDS = len(pii.KINDS)


def _segmentations(n, segments):
    """All ways through n tokens: lists of (first, end, label, segment), label 0 outside."""
    steps = [(j, j + 1, 0, -1) for j in range(n)] + [(i, j, kind + 1, k) for k, (i, j) in enumerate(segments) for kind in range(KINDS)]

    def go(at):
        if at == n:
            yield []
            return
        for step in steps:
            if step[0] == at:
                for rest in go(step[1]):
                    yield [step, *rest]

    return list(go(0))


def _value(field, way, scores):
    labels = [0, *(label for _, _, label, _ in way)]
    return sum(field.pairs[a, b] for a, b in zip(labels, labels[1:])) + sum(scores[k, label - 1] for _, _, label, k in way if k >= 0)


def _made(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6))
    every = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)]
    segments = [s for s in every if rng.random() < 0.5] or every[:1]
    field = pii.Field(rng.normal(0, 1, (pii.FEATURES, KINDS)), rng.normal(0, 1, (KINDS + 1, KINDS + 1)))
    return rng, n, segments, field, (rng.random((len(segments), pii.FEATURES)) < 0.2).astype(float)


@pytest.mark.parametrize("seed", range(25))
def test_the_best_segmentation_is_the_best_of_all(seed):
    _, n, segments, field, matrix = _made(seed)
    scores = matrix @ field.spans
    found = field.best(n, segments, scores)
    way, at = [], 0
    for i, j, kind in found:
        way += [(k, k + 1, 0, -1) for k in range(at, i)] + [(i, j, kind + 1, segments.index((i, j)))]
        at = j
    way += [(k, k + 1, 0, -1) for k in range(at, n)]
    assert _value(field, way, scores) == pytest.approx(max(_value(field, w, scores) for w in _segmentations(n, segments)))


@pytest.mark.parametrize("seed", range(8))
def test_the_field_s_gradient_equals_finite_differences(seed):
    rng, n, segments, field, matrix = _made(seed)
    truth, end = {}, 0
    for k in sorted(range(len(segments)), key=lambda k: segments[k]):
        if segments[k][0] >= end and rng.random() < 0.6:
            truth[k], end = int(rng.integers(KINDS)), segments[k][1]
    ways = _segmentations(n, segments)
    own = next(w for w in ways if {k: label - 1 for _, _, label, k in w if k >= 0} == truth)

    def likelihood(spans, pairs):
        f = pii.Field(spans, pairs)
        scores = matrix @ spans
        return _value(f, own, scores) - np.logaddexp.reduce([_value(f, w, scores) for w in ways])

    spans, pairs = field.gradient(n, segments, matrix, truth)
    for _ in range(3):
        a, b, eps = rng.normal(size=field.spans.shape), rng.normal(size=field.pairs.shape), 1e-6
        slope = (likelihood(field.spans + eps * a, field.pairs + eps * b) - likelihood(field.spans - eps * a, field.pairs - eps * b)) / (2 * eps)
        assert slope == pytest.approx((spans * a).sum() + (pairs * b).sum(), rel=1e-5, abs=1e-7)


def test_partition_sums_solve_the_ridge_problem(spark, monkeypatch):
    """The weights are those of one dense solution over all rows, however the rows are dealt."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, quality.N_STATS)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.3, 300) > 0.5).astype(int)
    rows = [(v.tolist(), int(t), k % 4 == 0) for k, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<float>, y int, calibrate boolean").repartition(5)
    kernel = quality.fit(df, features=20, width=0.8, ridge=0.05, seed=3, tasks=4)
    train = np.array([k % 4 != 0 for k in range(300)])
    assert kernel.mean == pytest.approx(x[train].astype(float).mean(0), abs=1e-6) and kernel.scale == pytest.approx(x[train].astype(float).std(0), rel=1e-4)
    z = kernel.lifted(x[train].astype(float))
    assert kernel.weights == pytest.approx(np.linalg.solve(z.T @ z + 0.05 * np.eye(21), z.T @ y[train]), abs=1e-8)
    assert (np.diff(kernel.steps[1]) >= 0).all() and ((kernel.score(x.astype(float)) >= 0) & (kernel.score(x.astype(float)) <= 1)).all()
    monkeypatch.setattr(quality, "TASK_ROWS", 10)  # more tasks as there are more rows
    assert quality.fit(df, features=20, width=0.8, ridge=0.05, seed=3, tasks=4).weights == pytest.approx(kernel.weights, abs=1e-8)


def test_random_features_approximate_a_gaussian_kernel():
    rng, d, width = np.random.default_rng(1), quality.N_STATS, 0.8
    kernel = quality.Kernel(np.zeros(d), np.ones(d), rng.normal(0, 1 / (width * np.sqrt(d)), (d, 20000)), rng.uniform(0, 2 * np.pi, 20000))
    x = np.clip(rng.normal(size=(6, d)), -6, 6)
    z = kernel.lifted(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * d * width**2))
    assert np.abs(z @ z.T - want).max() < 0.04


def test_isotonic_is_the_best_rising_line():
    """Least squares among all rising fits, by trying all ways to pool neighbours."""
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 7))
        count, share = rng.integers(1, 5, n).astype(float), rng.random(n)
        cost, best = np.inf, None
        for cuts in itertools.product((False, True), repeat=n - 1):
            blocks = np.concatenate([[0], np.cumsum(cuts)]).astype(int)
            mean = np.array([(share * count)[blocks == b].sum() / count[blocks == b].sum() for b in range(blocks[-1] + 1)])
            if (np.diff(mean) < 0).any():
                continue
            c = (count * (share - mean[blocks]) ** 2).sum()
            if c < cost - 1e-12:
                cost, best = c, mean[blocks]
        x, y = quality.isotonic(np.arange(n, dtype=float), share * count, count)
        fitted, k = [], 0
        for place, value in zip(x, y):  # a block's mean place tells how many values it pools
            size = next(z for z in range(1, n - k + 1) if np.isclose((np.arange(k, k + z) * count[k : k + z]).sum() / count[k : k + z].sum(), place))
            fitted += [value] * size
            k += size
        assert fitted == pytest.approx(best)
