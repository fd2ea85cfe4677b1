"""Operator 12 against brute force."""

import numpy as np
import pytest

from tenure.llm import multiindex, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows, least=0.9):
    """(n_links, component_id, kept) per row, by all pairs."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for d in {len(rows[i][1]) for i in good}:
        at = np.array([i for i in good if len(rows[i][1]) == d])
        x = np.array([rows[i][1] for i in at], np.float32).astype(float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        for u, v in np.argwhere(x @ x.T >= least):
            if u != v:
                links[at[u]].add(at[v])
    out = [None] * len(rows)
    for i in range(len(rows)):
        if out[i] is None:
            group, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - group
                group |= new
                todo += new
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            name = min(ids, default=None)
            for j in group:
                out[j] = (len(links[j]), name, rows[j][0] == name)
    return out


def _planted(seed, d=24, n=300, sizes=(120, 60, 9, 2, 2), spread=0.05):
    rng = np.random.default_rng(seed)
    vectors = [*rng.standard_normal((n, d))]
    for size in sizes:
        base = rng.standard_normal(d)
        vectors += [base + spread * np.sqrt(d) / 3 * rng.standard_normal(d) * rng.uniform(0, 3) for _ in range(size)]
    vectors += [vectors[5]] * 40 + [vectors[n + 3] * 2] * 3
    order = rng.permutation(len(vectors))
    return [(int(i) + 1, np.asarray(vectors[k], np.float32).tolist()) for i, k in enumerate(order)]


def _got(df):
    return sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in df.collect())


def _want(rows):
    return sorted((i or -1, n, c or -1, k) for (i, _), (n, c, k) in zip(rows, _brute(rows)))


@pytest.mark.parametrize("ball, part, residents, queries_", [(8, 50, 40, 60), (10_000, 50, 4096, 16_384), (5, 1000, 30, 16_384)])
def test_every_cell_visited_equals_brute_force(sp, ball, part, residents, queries_):
    rows = _planted(4, spread=0.2)
    df = sp.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    got = multiindex.near_duplicates(df, target=1, ball=ball, part=part, residents=residents, queries=queries_)
    assert _got(got) == _want(rows)


def test_calibrated_visits_find_the_links(sp):
    rows = _planted(5, d=64, n=1500, sizes=(150, 70, 30, *[2] * 40), spread=0.3)
    got = _got(multiindex.near_duplicates(sp.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)))
    want = _want(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)


def test_visits_are_few():
    x = np.random.default_rng(6).standard_normal((20_000, 64))
    grid = multiindex.Grid(x / np.sqrt((x * x).sum(1, keepdims=True)), 20_000, 0.9, multiindex.TARGET)
    assert grid.visits < 0.2 * grid.k ** 2
    some = x[:50] / np.sqrt((x[:50] ** 2).sum(1, keepdims=True))
    first, second = grid._scores(some)
    score = (first[:, :, None] + second[:, None, :]).reshape(50, -1)
    order = np.sort(score, 1)[:, :grid.visits]
    assert np.allclose(np.sort(np.take_along_axis(score, grid.visited(some), 1), 1), order)


def test_given_vectors_equal_brute_force(sp):
    rows = [(r["vec_id"], r["embedding"]) for r in sp.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    assert _got(queries.QUERIES["op12_embedding_dedup"](sp, "/root/testdata/sf0.1")) == _want(rows)


def test_odd_rows(sp):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 1.0]), (None, [-1.0, -1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]),
            (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [3.0]), (12, [4.0]), (13, [-4.0]), (14, [float("inf"), 0.0]), (15, [-0.0, 1.0]), (1, [1.0, 0.0])]
    want = [(i or -1, n, c or -1, k if i or c else True) for (i, _), (n, c, k) in zip(rows, _brute(rows))]
    assert _got(multiindex.near_duplicates(sp.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))) == sorted(want)
    assert _got(multiindex.near_duplicates(sp.createDataFrame([], SCHEMA))) == []
    wide = sp.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "2 AS cell")
    assert _got(multiindex.near_duplicates(wide)) == sorted(want)
