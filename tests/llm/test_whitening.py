"""Operator 13 against numpy's dense eigenvectors."""

import math

import numpy as np
import pytest

from tenure.llm import queries, whitening


def _dense(vectors):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], basis[:, ::-1]


def _compare(rows, vectors, k, close=1e-7):
    n, deviation, centred, values, basis = _dense(vectors)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == n * k
    for j in range(k):
        want = centred @ basis[:, j] / math.sqrt(values[j])
        have = np.array([got[i, j + 1]["whitened"] for i in range(n)])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < close
        assert got[0, j + 1]["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-9)
    assert all(got[i, 1]["deviation"] == deviation[i] and got[i, k]["n"] == n for i in range(n))
    assert rows[0]["identity_error"] < 1e-9


def test_whitening_equals_dense_eigenvectors(sp):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((300, 60)) * np.linspace(0.2, 2, 60)  # 60 > 32 + guard: the filter runs
    df = sp.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(data)], "vec_id long, embedding array<double>, component string").repartition(4)
    _compare(whitening.whiten(df).collect(), data.tolist(), 32)


def test_few_dimensions_and_few_components(sp):
    data = np.random.default_rng(2).standard_normal((50, 5)).tolist()
    df = sp.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    _compare(whitening.whiten(df).collect(), data, 5)
    _compare(whitening.whiten(df, components=2).collect(), data, 2)


def test_subspace_with_ties_and_low_rank():
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    for spectrum in (np.r_[np.full(5, 9.0), np.linspace(4, 3, 115)], np.r_[np.linspace(7, 1, 20), np.zeros(100)], np.ones(120)):
        v = basis * spectrum @ basis.T
        values, vectors, residual = whitening.subspace(lambda q: v @ q, 120, 32)
        want = spectrum[:32][spectrum[:32] > 0]
        assert np.allclose(values, want, atol=1e-10) and residual < whitening.TOLERANCE
        assert np.allclose(v @ vectors, vectors * values, atol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)


def test_given_vectors(sp):
    vectors = [r["embedding"] for r in sp.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()]
    rows = queries.QUERIES["op13_whitening"](sp, "/root/testdata/sf0.01").collect()
    _compare(rows, vectors, 32)


def test_odd_rows(sp):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 0.0]), (4, [-3.5, 0.25])]
    odd = [(5, None), (6, []), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (11, [1e300, 0.0])]
    df = sp.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (4, 1), (4, 2)]
    assert got[0]["identity_error"] < 1e-12
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(sp.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(sp.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)).count() == 0
    line = whitening.whiten(sp.createDataFrame([(i, [float(i), 2.0]) for i in range(9)], schema)).collect()
    assert len(line) == 9 and {r["component"] for r in line} == {1}


def test_deviation_beyond_a_long_is_null(sp):
    rows = [(0, [1e9, 0.0]), (1, [-1e9, 0.0]), (2, [0.0, 1.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(sp.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0] is None and got[2] == (2 * 64) ** 2
