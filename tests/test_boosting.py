"""Boosted families, forests and the search: growth rules against plain searches, joint growth against growth in one place."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators import boosting as bo
from tenure.operators import metrics as mt
from tenure.operators import trees as tr


def _rows(n=300, seed=0, missing=True):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 9, (4, n)).astype(np.uint8)
    if missing:
        x[0, rng.random(n) < 0.2] = 0
    y = ((x[1] > 4) ^ (x[2] > 5) | ((x[0] == 0) & (rng.random(n) < 0.8))).astype(float)
    return x, y, rng.integers(0, 1 << 62, n).astype(np.uint64)


def _gain(g, h, left, ridge):
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + ridge) if h[m].sum() + ridge > 0 else 0.0
    return part(left) + part(~left) - part(left | ~left)


def _splits(x, family):
    for f, b in itertools.product(range(len(x)), range(1, 9)):
        for missing in ([True] if family == "catboost" else [False, True]):
            yield (f, b, missing), np.where(x[f] == 0, missing, x[f] <= b)


def _plain_tree(rules, x, g, h):
    """Leaf of each row, by trying every split of every node."""
    leaf = np.zeros(len(g), int)
    level = {0: 0}

    def best(node):
        mine = leaf == node
        found = [(-np.inf, None)]
        for how, left in _splits(x[:, mine], rules.family):
            ok = all(left.sum() >= max(1, rules.least_rows) and (~left).sum() >= max(1, rules.least_rows)
                     and min(h[mine][left].sum(), h[mine][~left].sum()) >= rules.least_weight for _ in (0,))
            if ok:
                found.append((_gain(g[mine], h[mine], left, rules.ridge), how))
        return max(found, key=lambda t: t[0])

    def split(node, how):
        f, b, missing = how
        mine = np.flatnonzero(leaf == node)
        left = np.where(x[f, mine] == 0, missing, x[f, mine] <= b)
        a = max(level) + 1
        leaf[mine[left]], leaf[mine[~left]] = a, a + 1
        level[a] = level[a + 1] = level[node] + 1
        return a, a + 1

    if rules.family == "catboost":
        for depth in range(rules.depth):
            nodes = [n for n in set(leaf.tolist())]
            total = lambda left: sum(_gain(g[leaf == n], h[leaf == n], left[leaf == n], rules.ridge) for n in nodes)
            gain, how = max(((total(left), how) for how, left in _splits(x, rules.family)), key=lambda t: t[0])
            if gain <= 1e-9:
                break
            for n in nodes:
                split(n, how)
        return leaf
    if rules.family == "lightgbm":
        leaves = {0: best(0)}
        while len(leaves) < rules.leaves:
            node, (gain, how) = max(((n, s) for n, s in leaves.items() if level[n] < rules.depth), key=lambda t: t[1][0], default=(None, (-1, None)))
            if gain <= 1e-9:
                break
            del leaves[node]
            children = split(node, how)
            leaves |= {c: best(c) for c in children}
        return leaf
    todo = [0]
    while todo:
        node = todo.pop(0)
        gain, how = best(node)
        if level[node] < rules.depth and gain > 1e-9:
            todo += split(node, how)
    return leaf


@pytest.mark.parametrize("family, more", [("lightgbm", {"leaves": 6, "depth": 5, "least_rows": 5}), ("lightgbm", {"leaves": 4, "depth": 8, "least_rows": 1}),
                                          ("xgboost", {"depth": 3}), ("catboost", {"depth": 3})])
@pytest.mark.parametrize("logistic", [True, False])
def test_first_tree_equals_every_split_tried(family, more, logistic):
    x, y, row = _rows()
    rules = bo.rules(family, logistic, range(4), trees=1, **more)
    base, (tree,) = tr.fit_here(rules, x, y, row, [9] * 4)
    p = 1 / (1 + math.exp(-base)) if logistic else base
    g, h = np.full(len(y), p) - y, np.full(len(y), p * (1 - p) if logistic else 1.0)
    want, got = _plain_tree(rules, x, g, h), tree.leaf(x)
    value = {n: -g[want == n].sum() / (h[want == n].sum() + rules.ridge) for n in set(want.tolist())}
    assert np.allclose(tree.value[got], [value[n] for n in want.tolist()], atol=1e-6)


def test_families_grow_different_trees():
    x, y, row = _rows(600)
    got = {f: tr.fit_here(bo.rules(f, True, range(4), trees=1, depth=4, **({"leaves": 5} if f == "lightgbm" else {})), x, y, row, [9] * 4)[1][0] for f in ("lightgbm", "xgboost", "catboost")}
    leaves = {f: len(set(t.leaf(x).tolist())) for f, t in got.items()}
    assert leaves["lightgbm"] == 5 and leaves["catboost"] > leaves["lightgbm"] and leaves["xgboost"] > leaves["lightgbm"]
    t = got["catboost"]
    level = {0: 0}
    for n in range(len(t.feature)):
        if t.feature[n] >= 0:
            level[int(t.left[n])] = level[int(t.right[n])] = level[n] + 1
    for d in range(4):
        assert len({(int(t.feature[n]), int(t.threshold[n])) for n, v in level.items() if v == d and t.feature[n] >= 0}) == (1 if d < 2 else min(1, d in level.values() and any(t.feature[n] >= 0 for n, v in level.items() if v == d)))


def test_missing_values_take_the_better_side():
    x = np.array([[0] * 50 + [1] * 50 + [5] * 50], np.uint8)
    row = np.arange(150).astype(np.uint64)
    for y, left in ((np.r_[np.ones(100), np.zeros(50)], True), (np.r_[np.ones(50), np.zeros(50), np.ones(50)], False)):
        tree = tr.fit_here(bo.rules("xgboost", True, [0], trees=1, depth=1), x, y, row, [9])[1][0]
        assert bool(tree.missing_left[0]) is left


@pytest.mark.parametrize("family, more", [("lightgbm", {"leaves": 9, "least_rows": 1}), ("xgboost", {"depth": 5}), ("catboost", {"depth": 4}), ("random_forest", {"depth": 6})])
def test_rows_end_where_steps_from_the_root_lead(family, more, monkeypatch):
    x, y, row = _rows(700, 4)
    for tree in tr.fit_here(bo.rules(family, True, range(4), trees=3, **more), x, y, row, [9] * 4)[1]:
        want = np.zeros(700, np.int64)
        for _ in range(tree.depth):
            want = tr.step_down(tree, x, want)
        assert tree.leaf(x).tolist() == want.tolist() and tree.leaf(x[:, :0]).tolist() == []
        with monkeypatch.context() as m:
            m.setattr(tr, "MASKED_NODES", 0)
            assert tree.leaf(x).tolist() == want.tolist()


def test_a_pass_sends_a_few_pieces_not_a_row_per_cell(spark, frame, monkeypatch):
    """Histograms go through the shuffle in pieces, whose number follows that of the partitions and not of the cells."""
    columns, rows = bo.prepare(frame, ["a", "b", "c"], "label", KEYS)
    settings = [bo.rules(f, True, columns.of(f), trees=2) for f in ("lightgbm", "xgboost", "catboost")]
    want = [t.value.tolist() for m in bo.grow(rows, columns, settings, KEYS) for t in m.trees]
    sent, real = [], type(rows).mapInArrow

    def seen(df, f, schema):
        sent.append(schema)
        return real(df, f, schema)
    monkeypatch.setattr(type(rows), "mapInArrow", seen)
    for size in (7, bo.PIECE):
        monkeypatch.setattr(bo, "PIECE", size)
        assert [t.value.tolist() for m in bo.grow(rows, columns, settings, KEYS) for t in m.trees] == want
    assert set(sent) == {"piece long, sums binary"}


def test_row_draws_and_bootstrap():
    row = np.random.default_rng(1).integers(0, 1 << 62, 20_000).astype(np.uint64)
    some = bo.rules("xgboost", True, [0], rows_share=0.7)
    assert abs(tr.row_weights(some, row, 3).mean() - 0.7) < 0.02
    assert (tr.row_weights(some, row, 3) != tr.row_weights(some, row, 4)).any()
    times = tr.row_weights(bo.rules("random_forest", True, [0]), row, 0)
    assert abs(times.mean() - 1) < 0.03 and abs((times == 0).mean() - math.exp(-1)) < 0.02


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        a, b, c = float(rng.integers(0, 60)), float(rng.normal()), "abcdef"[rng.integers(0, 6)]
        y = int(a > 40) | int(c in "ab") if rng.random() < 0.9 else int(rng.integers(0, 2))
        rows.append((i, 1, None if rng.random() < 0.1 else a, b, None if rng.random() < 0.05 else c, y, float(y) * 2 + (a % 3), i % 3))
    return bo.numbered(spark.createDataFrame(rows, "user_id long, p_mt int, a double, b double, c string, label int, bought double, fold int"))


KEYS = ["user_id", "p_mt"]


@pytest.mark.parametrize("label", ["label", "bought"])
def test_joint_growth_equals_growth_in_one_place(spark, frame, label):
    columns, rows = bo.prepare(frame, ["a", "b", "c"], label, KEYS)
    logistic = label == "label"
    settings = [bo.rules(f, logistic, columns.of(f), trees=n, **more) for f, n, more in
                (("lightgbm", 12, {"leaves": 7}), ("xgboost", 4, {"rows_share": 0.8}), ("catboost", 3, {}), ("xgboost", 3, {}))]
    together = bo.grow(rows.repartition(5), columns, settings, KEYS, "fold", [None, None, None, 1])
    pdf = rows.select("*", F.xxhash64(*KEYS).alias("_id")).toPandas()
    for fitted, setting, out in zip(together, settings, (None, None, None, 1)):
        mine = pdf if out is None else pdf[pdf["fold"] != out]
        bins = bo.to_bins(mine, columns.cuts)
        base, trees = tr.fit_here(setting, bins, mine[label].to_numpy(float), mine["_id"].to_numpy(np.int64).view(np.uint64), columns.widths)
        assert base == pytest.approx(fitted.base, abs=1e-12) and len(trees) == len(fitted.trees)
        for a, b in zip(trees, fitted.trees):
            assert a.feature.tolist() == b.feature.tolist() and a.threshold.tolist() == b.threshold.tolist()
            assert np.allclose(a.value, b.value, atol=1e-9)


def test_ordered_statistics_never_see_their_own_row(frame):
    columns, rows = bo.prepare(frame, ["a", "b", "c"], "label", KEYS)
    before = {r["_row"]: r["ts c"] for r in rows.collect()}
    one = rows.first()["_row"]
    turned = frame.withColumn("label", F.when(F.col("_row") == one, 1 - F.col("label")).otherwise(F.col("label")))
    columns2 = bo.Columns(columns.numeric, columns.categorical, columns.dictionary, columns.totals, columns.prior, "label")
    after = {r["_row"]: r["ts c"] for r in columns2.ordered(turned, KEYS).collect()}
    assert after[one] == before[one] and before.keys() == after.keys()
    assert any(after[k] != before[k] for k in before)
    by = rows.toPandas()
    codes = by["c"].to_numpy()
    h = {r["_row"]: r["h"] for r in frame.select("_row", bo.hash32(KEYS, bo.SEED).alias("h")).collect()}
    order = by["_row"].map(h).to_numpy(np.uint64)
    assert np.allclose(by["ts c"], bo.ordered_here(codes, by["label"].to_numpy(float), order, columns.prior))


def test_scores_follow_the_label(frame):
    columns, rows = bo.prepare(frame.where("fold < 2"), ["a", "b", "c"], "label", KEYS)
    models = dict(zip(["m1", "m2", "m3"], bo.grow(rows, columns, [bo.rules(f, True, columns.of(f), trees=15) for f in ("lightgbm", "xgboost", "catboost")], KEYS)))
    held = bo.scored(frame.where("fold = 2"), columns, models)
    assert held.count() == 300
    for name in models:
        assert mt.ap_auc(held, name, "label").first()["roc_auc"] > 0.8


def test_average_precision_equals_the_operator(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 30, 200) / 30
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    assert bo.average_precision(y.astype(float), s) == pytest.approx(mt.ap_auc(df, "s", "y").first()["ap"], abs=1e-10)
    assert bo.average_precision(np.zeros(3), np.ones(3)) is None and bo.r_squared(np.ones(3), np.ones(3)) is None


def test_search_stays_within_bounds_repeats_and_beats_random_draws():
    for family, bounds in bo.SEARCH.items():
        search = bo.Parzen(bounds)
        asked = []
        for k in range(20):
            asked.append(search.ask())
            search.tell(asked[-1], float(k % 5))
        again = bo.Parzen(bounds)
        for k in range(20):
            assert again.ask() == asked[k]
            again.tell(asked[k], float(k % 5))
        assert all(s.keys() == bounds.keys() and all(low <= s[p] <= high and isinstance(s[p], type(low)) for p, (low, high) in bounds.items()) for s in asked)
    surface = lambda s: -((math.log(s["rate"]) - math.log(0.04)) ** 2) - ((s["depth"] - 6) / 5) ** 2
    bounds = {"rate": (0.001, 1.0), "depth": (1, 30)}
    found = {startup: [] for startup in (10, 60)}
    for seed in range(12):
        for startup in found:
            search = bo.Parzen(bounds, seed, startup)
            values = []
            for _ in range(60):
                s = search.ask()
                values.append(surface(s))
                search.tell(s, values[-1])
            found[startup].append(np.mean(values[30:]))
    assert np.mean(found[10]) > np.mean(found[60]) + 0.5


@pytest.mark.parametrize("family, bounds", [("random_forest", {"trees": (3, 5), "depth": (2, 4), "features_share": (0.7, 1.0)}),
                                            ("catboost", {"trees": (5, 8), "depth": (2, 3)}), ("lightgbm", {"trees": (5, 8), "rate": (0.05, 0.3)})])
@pytest.mark.parametrize("label", ["label", "bought"])
def test_tuning_scores_every_fold_and_keeps_the_best(spark, frame, family, bounds, label):
    data = bo.tuning_sample(frame, ["a", "b", "c"], label, KEYS, "fold")
    best, trials = bo.tune(spark, data, family, label == "label", 5, bounds, startup=3, round_size=2)
    assert [len(t["folds"]) for t in trials] == [3] * 5
    assert best == max(trials, key=lambda t: t["mean"])["params"]
    assert label != "label" or all(t["mean"] > 0.5 for t in trials)
    assert (best, trials) == bo.tune(spark, data, family, label == "label", 5, bounds, startup=3, round_size=2)


def test_tuning_sample_is_bounded(frame):
    assert len(bo.tuning_sample(frame, ["a", "b", "c"], "label", KEYS, "fold", 100)["y"]) == 100


def test_every_family_and_task_is_registered():
    from tenure.plans import q_models, registry
    assert {f"m7_tuning_{t}_{f}" for t in q_models.TASKS for f in bo.SEARCH} <= registry.QUERIES.keys() and bo.TRIALS == 20
