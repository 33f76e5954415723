"""Whitening: the solver against dense decompositions, the operator against the covariance of all distinct vectors."""

import math

import numpy as np
import pytest

from evalspark.llm import whitening


def symmetric(values, seed=0):
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (turn * values) @ turn.T


@pytest.mark.parametrize(
    "values, wanted, space",
    [
        (np.linspace(1, 100, 64), 16, None),
        (np.concatenate([[400, 130], 66 - np.arange(62) * 0.1]), 16, None),
        (np.concatenate([np.full(5, 9.0), np.linspace(0, 8, 195)]), 8, 40),
        (np.linspace(0, 1, 300) ** 8, 6, 30),
        (np.array([3.0, 0, 0, 0]), 4, None),
        (np.zeros(5), 3, None),
        (np.array([2.0]), 16, None),
    ],
)
def test_leading_pairs(values, wanted, space):
    v = symmetric(values)
    pairs = whitening.jacobi_davidson(lambda b: v @ b, len(values), wanted, largest_space=space)
    want = np.sort(values)[::-1][:wanted]
    assert np.allclose(pairs.values, want, atol=1e-12 * max(values.max(), 1))
    assert (pairs.residuals <= 1e-12 * max(values.max(), 1)).all()
    assert np.allclose(pairs.vectors.T @ pairs.vectors, np.eye(len(want)), atol=1e-12)


def test_minres_solves_each_column():
    v = symmetric(np.linspace(-3, 5, 30))
    right = np.random.default_rng(3).standard_normal((30, 4))
    right[:, 2] = 0
    x = whitening.minres(lambda b: v @ b, right, 60, 1e-12)
    assert np.allclose(v @ x, right, atol=1e-9)


def brute(vectors, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = sorted({tuple(r) for r in x})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([float(a) / n for a in s])
    centred = np.array(fit, dtype=float) - mean
    cov = centred.T @ centred / n
    values, turns = np.linalg.eigh(cov)
    deviation = [sum((n * c - a) ** 2 for c, a in zip(r, s)) for r in x]
    return n, deviation, values[::-1][:k], turns[:, ::-1][:, :k], x.astype(float) - mean, np.trace(cov)


@pytest.mark.parametrize("d, rows", [(24, 300), (5, 40)])
def test_whitened_rows(spark, d, rows):
    rng = np.random.default_rng(d)
    vectors = rng.standard_normal((rows, d)) * np.linspace(0.2, 1.5, d)
    vectors[rows // 2 :] = vectors[0]
    good = [(int(i) * 10**10, v.astype(np.float32).tolist(), "x") for i, v in enumerate(vectors)]
    bad = [(-1, None, "x"), (-2, [None] * d, "x"), (-3, [float("nan")] * d, "x"), (-4, [math.inf] + [0.0] * (d - 1), "x"), (-5, [], "x"), (-6, [1.0] * (d + 1), "x")]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, component string").repartition(6)
    got = whitening.whiten(table).collect()
    k = min(16, d)
    n, deviation, values, turns, centred, trace = brute([v for _, v, _ in good], k)
    assert len(got) == rows * k
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        want = centred @ turns[:, c] / np.sqrt(values[c])
        have = np.array([by[g[0], c + 1].whitened for g in good])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
    for i, g in enumerate(good):
        r = by[g[0], 1]
        assert (r.n, r.deviation) == (n, deviation[i]) and abs(r.explained - values[0] / trace) < 1e-12 and r.identity_error < 1e-9


def test_partial_products_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT_BYTES", 8)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = whitening.whiten(table).collect()
    _, _, values, _, _, trace = brute([v for _, v in rows], 3)
    assert {r.component: r.explained for r in got} == pytest.approx({i + 1: v / trace for i, v in enumerate(values)})


def test_no_variance_ties_nulls_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, 1.0])], schema)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], schema)).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and abs(line[0].explained - 1) < 1e-12
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0


def test_exact_deviations():
    x = np.array([[10**12, 0], [5, 7]])
    n, sums = 3, np.array([10**12 + 6, 9])
    assert whitening._deviations(x, n, sums) == [None, (15 - 10**12 - 6) ** 2 + (21 - 9) ** 2 if (15 - 10**12 - 6) ** 2 < 2**63 else None]
    assert whitening._deviations(x[1:], 3, np.array([14, 20])) == [2]
