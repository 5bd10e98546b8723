"""Whitening against dense linear algebra, and the counts of the spectrum against known spectra."""

import math

import numpy as np
import pytest

from voxframe.llm import whitening


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [3, 3, 3, 1, 1], [7, 0, 0, 0], [2, -1, -1, -5, 0.1], [1e12, 1e6, 1, 1e-3], [1.0, 1 - 1e-9, 1 - 2e-9, 0.1]])
def test_pivots_count_eigenvalues(values):
    v = symmetric(values)
    for shift in [x + d for x in values for d in (-1e-3, 1e-3)]:
        if min(abs(np.array(values) - shift)) > 1e-9 * max(map(abs, values)):
            assert whitening.negative_pivots(v - shift * np.eye(len(v))) == sum(x < shift for x in values)
    assert whitening.negative_pivots(np.array([[0.0, 1], [1, 0]])) == 1 and whitening.negative_pivots(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("values", [[9, 7, 5, 3, 1, 0.2, 0.1], [4, 4, 4, 1, 1], [1.0, 1 - 1e-10, 1 - 2e-10, 0.5, 0.1], [6, 1e-20, 0, 0, 0], [0, 0, 0], [1e14, 1, 1e-3, 1e-4, 1e-5], [2.0]])
def test_leading_pairs(values):
    v = symmetric(values, 3)
    e, y = whitening.Spectrum(v).pairs(4)
    want = np.linalg.eigvalsh(v)[::-1][: len(e)]
    assert len(e) == min(4, len(values)) and np.allclose(e, want, atol=1e-13 * max(values[0], 1e-300), rtol=1e-12)
    assert np.allclose(y @ y.T, np.eye(len(e)), atol=1e-12) and np.abs(y @ v - e[:, None] * y).max() <= 1e-12 * max(values[0], 1e-300)


def dense(rows, k=4):
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array(fit, float) - np.array([v / n for v in s])
    cov = m.T @ m / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    dev = {i: sum((n * c - t) ** 2 for c, t in zip(v, s)) for i, v in x.items()}
    w = {i: (np.array(v) - np.array([t / n for t in s])) @ q[:, :k] / np.sqrt(e[:k]) for i, v in x.items()}
    return n, dev, w, e[:k] / np.trace(cov)


def test_matches_dense_algebra(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=12) * np.linspace(3, 0.2, 12)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(300)] + [(1000, [0.0] * 12), (1001, [-0.0] * 12)]
    odd = [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [1.0] * 5), (2005, []), (2006, [3e38] + [0.0] * 11)]
    more = [(None, rows[0][1]), rows[1]]
    d = spark.createDataFrame([(i, v, "a", 1) for i, v in rows + odd + more], "vec_id long, embedding array<float>, x string, n int").repartition(5)
    got = whitening.whiten(d).collect()
    n, dev, w, explained = dense(rows)
    assert len(got) == 4 * (len(rows) + 2) and {r.n for r in got} == {n} and sum(r.vec_id is None for r in got) == 4
    sign = {}
    for r in got:
        i = 0 if r.vec_id is None else r.vec_id
        assert r.deviation == dev[i] and abs(r.explained - explained[r.component - 1]) < 1e-12 and r.identity_error < 1e-9
        k = r.component - 1
        if abs(w[i][k]) > 1e-3:
            assert sign.setdefault(k, np.sign(r.whitened * w[i][k])) == np.sign(r.whitened * w[i][k])
        assert abs(abs(r.whitened) - abs(w[i][k])) < 1e-8


def test_without_variance_and_past_64_bits(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one)
    line = whitening.whiten(make([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and all(abs(r.explained - (r.component == 1)) < 1e-12 for r in line)
    big = whitening.whiten(make([(1, [1e12, 0.0]), (2, [0.0, 1e3]), (3, [0.0, 0.0])]), components=1).collect()
    assert {r.vec_id: r.deviation for r in big} == {1: None, 2: None, 3: None}
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None)])).count() == 0
