"""Operator 12, embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into two halves with a codebook each (k-means on a bounded sample); the product of the codebooks
is a grid of cells. A vector visits the cells nearest to it in multi-sequence order (by the sum of both halves'
distances to the cell's centroids) and every vector in them is verified: pairs link from cosine ``least`` on. How many cells
are visited is calibrated: partners at exactly ``least``, the hardest case, are drawn around sample vectors, and the
visits are what finds ``target`` of them from either side. Any number of partners is found; nothing is capped.

Large groups never become pairs. Equal vectors are one class. In cells of ``BALL`` classes and more, classes within half
the linking angle of a leader form a ball, so all its pairs link (angles obey the triangle inequality); cells are split
into parts of ``PART`` for that. Balls are compared as one item with a radius: two items link wholly, or not at all, or
their members are compared in a second step. Tasks return link counts per item and a spanning forest of the links, never
pairs. Both sides of a comparison are split into parts of bounded size, whatever the size of a group of cells.

Defined cases: null, empty and zero vectors and those with null or non-finite components link with nothing; so do
vectors of different lengths. Ids may repeat (a row is a vector); null ids take part, and a group is named by its
smallest id, or null if it has none (then all its rows are kept). An empty table gives no rows. Classes are formed by
128 bits of hash, which join two different vectors among n with odds of about n²/2¹²⁹. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.components import connected
from tenure.llm.shared import written

LEAST = 0.9
TARGET = 0.999
#: Rows that codebooks and visits are fitted on, at most about this many; every row is indexed.
SAMPLE = 32_768
CENTROIDS = 2048
PER_CELL = 32
BALL = 64
PART = 2048
RESIDENTS = 4096
QUERIES = 16_384
SEED = 12
#: Angles near zero carry errors of up to 2e-8 in double precision.
_SLACK = 1e-6
COUNT, EDGE, OPEN = 0, 1, 2
FOUND = "kind int, a long, b long, n long"


def _unit(column: pa.Array | pd.Series, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if isinstance(column, pa.Array) else np.stack(column.to_list())
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _far(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0.0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means centroids, ordered along their widest direction so that neighbours have near numbers."""
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _far(x, centroids).argmin(1)
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    away = centroids - centroids.mean(0)
    return centroids[np.argsort(away @ np.linalg.svd(away, full_matrices=False)[2][0])] if x.shape[1] and k > 1 else centroids


class Grid:
    """Codebooks of one vector length, and how many cells are visited."""

    def __init__(self, sample: np.ndarray, n: int, least: float, target: float):
        rng = np.random.default_rng(SEED)
        self.d, self.half = sample.shape[1], sample.shape[1] // 2
        self.k = int(min(max(1, round(math.sqrt(n / PER_CELL))), CENTROIDS, max(1, len(sample) // 8)))
        self.books = [codebook(h, self.k, rng) for h in self.halves(sample)]
        some = sample[rng.permutation(len(sample))[:1024]]
        aside = rng.standard_normal(some.shape)
        aside -= (aside * some).sum(1, keepdims=True) * some
        norm = np.sqrt((aside * aside).sum(1, keepdims=True))
        partner = least * some + math.sqrt(1 - least * least) * aside / np.where(norm > 0, norm, 1)
        partner /= np.sqrt((partner * partner).sum(1, keepdims=True))
        ranks = np.sort(np.minimum(self._rank(some, partner), self._rank(partner, some)))
        self.visits = self.k * self.k if target >= 1 else int(ranks[min(len(ranks) - 1, int(math.ceil(target * len(ranks))))]) + 1
        a, b = np.meshgrid(np.arange(self.k), np.arange(self.k), indexing="ij")
        near = (a + 1) * (b + 1) <= self.visits  # of a pair of ranks, all pairs below it come before it
        self.rank_a, self.rank_b = a[near], b[near]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.half], x[:, self.half:]

    def _scores(self, x: np.ndarray) -> list[np.ndarray]:
        return [_far(h, book) for h, book in zip(self.halves(x), self.books)]

    def _rank(self, x: np.ndarray, other: np.ndarray) -> np.ndarray:
        """At which place x visits the other's cell (0: first)."""
        mine, cell = self._scores(x), [s.argmin(1) for s in self._scores(other)]
        out = np.empty(len(x), np.int64)
        for r in range(len(x)):
            score = mine[0][r, cell[0][r]] + mine[1][r, cell[1][r]]
            out[r] = np.searchsorted(np.sort(mine[1][r]), score - mine[0][r], "left").sum()
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        i, j = (s.argmin(1) for s in self._scores(x))
        return i * self.k + j

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The cells each row visits (rows x visits), the first ``visits`` of the multi-sequence order."""
        first, second = self._scores(x)
        order = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
        ranked = [np.take_along_axis(s, o, 1) for s, o in zip((first, second), order)]
        score = ranked[0][:, self.rank_a] + ranked[1][:, self.rank_b]
        top = np.argsort(score, 1, kind="stable")[:, :self.visits]
        return np.take_along_axis(order[0], self.rank_a[top], 1) * self.k + np.take_along_axis(order[1], self.rank_b[top], 1)


def usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, and where it takes part the vector ``v`` and its hash ``h1``, ``h2``."""
    narrow = rows.schema[vector].dataType.elementType.typeName() == "float"  # kept as given: half the bytes to shuffle
    v = F.transform(F.col(vector).cast("array<double>"), lambda c: c + 0.0).cast(f"array<{'float' if narrow else 'double'}>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.coalesce(finite & F.exists("v", lambda c: c != 0), F.lit(False))
    got = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("v", F.when(good, F.col("v")))
    return got.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(SEED), "v"))})


def fit(classes: DataFrame, n: int, least: float, target: float) -> dict[int, Grid]:
    """A grid per vector length, from about ``SAMPLE`` classes drawn by hash."""
    some = classes.where(F.pmod(F.col("h2"), F.lit(max(n, 1))) < SAMPLE).select("d", "v").toArrow().combine_chunks()
    share = n / max(1, some.num_rows)
    grids, lengths = {}, some["d"].to_numpy()
    for d in np.unique(lengths).tolist():
        mine = some.filter(pa.array(lengths == d))["v"].combine_chunks()
        grids[d] = Grid(_unit(mine, d), int(len(mine) * share), least, target)
    return grids


def with_cells(classes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """Classes with their cell; lengths that the sample lacks have a single cell."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            d = batch.column("d").to_numpy()
            out = np.zeros(batch.num_rows, np.int64)
            for length in np.unique(d).tolist():
                at = np.flatnonzero(d == length)
                if length in grids:
                    out[at] = grids[length].cells(_unit(batch.column("v").take(pa.array(at)), length))
            yield batch.append_column("cell", pa.array(out))
    return classes.mapInArrow(cells, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema) + ", cell long")


def in_balls(placed: DataFrame, least: float, ball: int = BALL, part: int = PART) -> DataFrame:
    """Classes with their ball's ``leader`` (their own node where alone) and the angle to it.

    Only cells of ``ball`` classes and more are looked into, in parts of about ``part``.
    """
    half = math.acos(least) / 2 - _SLACK
    full = placed.groupBy("d", "cell").count().where(F.col("count") >= ball)
    parts = full.select("d", "cell", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    placed = placed.join(parts, ["d", "cell"], "left")
    schema = "node long, leader long, angle double"

    def balls(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node, x = pdf["node"].to_numpy(), _unit(pdf["v"], len(pdf["v"].iloc[0]))
        leader, angle, left = node.copy(), np.zeros(len(node)), np.arange(len(node))
        while len(left):
            apart = np.arccos(np.clip(x[left] @ x[left[0]], -1, 1))
            apart[0] = 0.0
            near = apart <= half
            if near.sum() >= ball:
                leader[left[near]], angle[left[near]] = node[left[0]], apart[near]
                left = left[~near]
            else:
                left = left[1:]
        return pd.DataFrame({"node": node, "leader": leader, "angle": angle})

    dealt = placed.where("parts IS NOT NULL").select("node", "d", "cell", "v", F.pmod("h1", "parts").alias("part"))
    found = dealt.groupBy("d", "cell", "part").applyInPandas(balls, schema).where("leader <> node")
    kept = placed.drop("parts").join(found, "node", "left")
    return kept.withColumns({"leader": F.coalesce("leader", "node"), "angle": F.coalesce("angle", F.lit(0.0))})


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs a, b (places in ``label``): every place gets its group's smallest place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _rows(node: np.ndarray, n: np.ndarray, edges: tuple[np.ndarray, np.ndarray], opened: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    node, n = node[n > 0], n[n > 0]
    sizes = [len(node), len(edges[0]), len(opened[0])]
    zero = [np.zeros(k, np.int64) for k in sizes]
    return pd.DataFrame({"kind": np.repeat([COUNT, EDGE, OPEN], sizes).astype(np.int32), "a": np.concatenate([node, edges[0], opened[0]]),
                         "b": np.concatenate([zero[0], edges[1], opened[1]]), "n": np.concatenate([n, zero[1], zero[2]])})


_NONE = np.empty(0, np.int64)


def visiting(items: DataFrame, grids: dict[int, Grid], n: int, residents: int = RESIDENTS) -> DataFrame:
    """Items with the sorted cells they visit, and these cut by group of cells: what meets in a task.

    A group is a centroid of the first half with a stretch of centroids of the second: ``groups`` are those visited, and
    ``cuts`` where each one's cells begin and end.
    """
    wide = {d: max(1, math.ceil(g.k / max(1, math.ceil(n / g.k / residents)))) for d, g in grids.items()}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            d, cell = batch.column("d").to_numpy(), batch.column("cell").to_numpy()
            seen: list = [[0]] * batch.num_rows
            groups: list = [[0]] * batch.num_rows
            cuts: list = [[0, 1]] * batch.num_rows
            own = np.zeros(batch.num_rows, np.int64)
            for length in np.unique(d).tolist():
                if length in grids:
                    at, grid, w = np.flatnonzero(d == length), grids[length], wide[length]
                    got = np.sort(grid.visited(_unit(batch.column("v").take(pa.array(at)), length)), 1)
                    group = got // grid.k * grid.k + got % grid.k // w
                    own[at] = cell[at] // grid.k * grid.k + cell[at] % grid.k // w
                    for r, c, g in zip(at.tolist(), got, group):
                        groups[r], start = np.unique(g, return_index=True)
                        seen[r], cuts[r] = c, np.append(start, len(c))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(seen, pa.list_(pa.int64())), pa.array(groups, pa.list_(pa.int64())),
                                              pa.array(cuts, pa.list_(pa.int32()))], [*batch.schema.names, "own", "visits", "groups", "cuts"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return items.mapInArrow(visits, schema + ", own long, visits array<long>, groups array<long>, cuts array<int>")


def compared(items: DataFrame, least: float, n_residents: int = RESIDENTS, n_queries: int = QUERIES) -> DataFrame:
    """Link counts and forests of the items, and the pairs of balls left open (``FOUND`` rows)."""
    limit = math.acos(least)
    residents = items.withColumnRenamed("own", "g").drop("groups", "cuts")
    queries = items.select("*", F.posexplode("groups").alias("_at", "g"))
    here = F.slice("visits", F.col("cuts")[F.col("_at")] + 1, F.col("cuts")[F.col("_at") + 1] - F.col("cuts")[F.col("_at")])
    queries = queries.withColumn("visits", here).drop("own", "groups", "cuts", "_at")
    sizes = residents.groupBy("d", "g").agg(F.count("*").alias("n_r"))
    asked = queries.groupBy("d", "g").agg(F.count("*").alias("n_q"))
    parts = sizes.join(asked, ["d", "g"]).select("d", "g", F.ceil(F.col("n_r") / n_residents).cast("int").alias("rs"), F.ceil(F.col("n_q") / n_queries).cast("int").alias("qs"))
    parts = written(parts, "parts")
    some = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
    residents = residents.join(parts, ["d", "g"]).withColumn("r_part", mine("rs")).withColumn("q_part", some("qs")).drop("rs", "qs")
    queries = queries.join(parts, ["d", "g"]).withColumn("q_part", mine("qs")).withColumn("r_part", some("rs")).drop("rs", "qs")

    def compare(key: tuple, have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(ask):
            return _rows(_NONE, _NONE, (_NONE, _NONE), (_NONE, _NONE))
        have = have.sort_values("cell", kind="stable")
        x, y = _unit(have["v"], int(key[0])), _unit(ask["v"], int(key[0]))
        node = np.concatenate([ask["node"].to_numpy(), have["node"].to_numpy()])
        node_y, node_x = node[:len(ask)], node[len(ask):]
        far_x, far_y, size_x, size_y = have["radius"].to_numpy(), ask["radius"].to_numpy(), have["weight"].to_numpy(), ask["weight"].to_numpy()
        cell_x, cell_y = have["cell"].to_numpy(), ask["cell"].to_numpy()
        # what residents visit, as sorted (resident, cell) keys
        seen = np.concatenate(have["visits"].to_list())
        top = int(max(seen.max(), cell_x.max(), cell_y.max())) + 1
        seen += np.repeat(np.arange(len(have)), have["visits"].map(len)) * top
        wanted = np.concatenate(ask["visits"].to_list())
        by_cell = np.argsort(wanted, kind="stable")
        asker, wanted = np.repeat(np.arange(len(ask)), ask["visits"].map(len))[by_cell], wanted[by_cell]
        n_y, n_x, label, opened = np.zeros(len(ask)), np.zeros(len(have)), np.arange(len(node)), [(_NONE, _NONE)]

        def once(hit: np.ndarray, q: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
            """Places of the hits; a pair whose sides both visit is taken from its smaller node's side."""
            u, v = np.nonzero(hit)
            u, v = q[u], v + lo
            back = np.searchsorted(seen, v * top + cell_y[u])
            both = seen[np.minimum(back, len(seen) - 1)] == v * top + cell_y[u]
            take = (node_y[u] < node_x[v]) | ((node_y[u] > node_x[v]) & ~both)
            return u[take], v[take]

        cells, first = np.unique(cell_x, return_index=True)
        last, q_lo, q_hi = np.append(first[1:], len(cell_x)), np.searchsorted(wanted, cells), np.searchsorted(wanted, cells, "right")
        for lo, hi, q0, q1 in zip(first.tolist(), last.tolist(), q_lo.tolist(), q_hi.tolist()):
            step = max(1, (1 << 20) // (hi - lo))
            for at in range(q0, q1, step):
                q = asker[at:min(at + step, q1)]
                cos = y[q] @ x[lo:hi].T
                reach = far_y[q][:, None] + far_x[lo:hi][None]
                sure = cos >= least
                if reach.any():
                    gap = np.arccos(np.clip(cos, -1, 1))
                    sure = np.where(reach > 0, gap + reach <= limit - _SLACK, sure)
                    opened.append(tuple(nodes[k] for nodes, k in zip((node_y, node_x), once((reach > 0) & ~sure & (gap - reach <= limit + _SLACK), q, lo))))
                u, v = once(sure, q, lo)
                n_y += np.bincount(u, size_x[v], len(ask))
                n_x += np.bincount(v, size_y[u], len(have))
                label = _merge(label, u, len(ask) + v)
        linked = np.flatnonzero(label != np.arange(len(node)))
        counts = np.concatenate([n_y, n_x]).astype(np.int64)
        return _rows(node, counts, (node[linked], node[label[linked]]), tuple(np.concatenate(o) for o in zip(*opened)))

    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of its own, as both sides come from one table
    keys = ["d", "g", "r_part", "q_part"]
    return residents.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(compare, FOUND)


def opened_balls(opened: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Open pairs of items, member against member: counts per class, and an edge between leaders that link at all."""
    own = members.select(F.col("leader").alias("a"), F.col("node").alias("node"), "v", "copies")
    other = opened.join(members.select(F.col("leader").alias("b"), F.col("node"), "v", "copies"), "b").select("a", "b", "node", "v", "copies")
    parts = other.groupBy("a").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    other = other.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).drop("parts")
    own = own.join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def compare(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        x, edges = _unit(mine["v"], 0), set()
        n_x, n_y = np.zeros(len(mine)), np.zeros(len(theirs))
        for at in range(0, len(theirs), 512):
            some = theirs.iloc[at:at + 512]
            hit = x @ _unit(some["v"], 0).T >= least
            n_x += hit @ some["copies"].to_numpy(np.float64)
            n_y[at:at + len(some)] = mine["copies"].to_numpy(np.float64) @ hit
            edges |= set(some["b"].to_numpy()[hit.any(0)].tolist())
        b = np.array(sorted(edges), np.int64)
        node = np.concatenate([mine["node"].to_numpy(), theirs["node"].to_numpy()])
        return _rows(node, np.concatenate([n_x, n_y]).astype(np.int64), (np.full(len(b), int(key[0])), b), (_NONE, _NONE))

    other = other.select(*[F.col(c).alias(c) for c in other.columns])
    return own.groupBy("a", "part").cogroup(other.groupBy("a", "part")).applyInPandas(compare, FOUND)


def near_duplicates(rows: DataFrame, least: float = LEAST, target: float = TARGET, id_col: str = "vec_id", vector: str = "embedding", ball: int = BALL,
                    part: int = PART, residents: int = RESIDENTS, queries: int = QUERIES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row. A ``target`` of 1 visits every cell."""
    given = usable(rows, id_col, vector)
    classes = (given.where("v IS NOT NULL").groupBy("h1", "h2")
               .agg(F.first("v").alias("v"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies")))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "classes")
    n = classes.count()
    grids = fit(classes, n, least, target)
    members = written(in_balls(with_cells(classes, grids), least, ball, part), "members")
    weights = members.where("leader <> node").select("leader").distinct()
    weights = members.join(weights, "leader", "left_semi").groupBy("leader").agg(F.max("angle").alias("radius"), F.sum("copies").alias("weight"))
    items = (members.where("leader = node").drop("leader", "angle").join(weights.withColumnRenamed("leader", "node"), "node", "left")
             .select("node", "d", "cell", "v", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("weight", "copies").alias("weight")))
    items = written(visiting(items, grids, n, residents), "items")
    found = written(compared(items, least, residents, queries), "found")
    more = written(opened_balls(found.where(F.col("kind") == OPEN).select("a", "b"), members, least), "opened")
    counted = lambda f, key: f.where(F.col("kind") == COUNT).groupBy(F.col("a").alias(key)).agg(F.sum("n").alias(f"n_{key}"))
    edges = found.union(more).where(F.col("kind") == EDGE).select("a", "b")
    labels = connected(edges).select(F.col("node").alias("leader"), "label")
    named = (members.select("h1", "h2", "node", "leader", "least_id", "copies")
             .join(items.select(F.col("node").alias("leader"), "weight"), "leader")
             .join(counted(found, "leader"), "leader", "left").join(counted(more, "node"), "node", "left")
             .join(labels, "leader", "left").withColumn("label", F.coalesce("label", "leader")))
    named = written(named.select("h1", "h2", "label", "least_id",
                                 (F.col("weight") - 1 + F.coalesce("n_leader", F.lit(0)) + F.coalesce("n_node", F.lit(0))).alias("n_links")), "named")
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "label").select("h1", "h2", "n_links", "component_id", F.lit(True).alias("part"))
    out = given.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("part"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
