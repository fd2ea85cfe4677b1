"""How the boosted families and forests grow a tree from histograms (M6, M7).

Nothing here reads rows of a table: ``Growth`` is given, for each of its open nodes, sums of gradients, second
derivatives and rows per column and bin, and says which nodes to open next. ``boosting`` gets those sums from a
grouped Spark aggregate over all rows, or, when many settings are tried on one bounded sample, inside a task.

Bin 0 holds missing values; bins 1.. are value ranges in order, and a split at bin b sends 1..b to the left.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Gradients are rounded to multiples of the largest one / 2^30, so that sums do not depend on their order.
GRADIENT_BITS = 30
_LEAST_GAIN = 1e-9
#: Nodes with a split up to which a tree is gone through node by node: its leaves then have numbers of a byte.
MASKED_NODES = 128


@dataclass(frozen=True)
class Rules:
    """A family's growth rule and its settings."""
    family: str
    logistic: bool
    trees: int = 100
    depth: int = 5
    rate: float = 0.1
    leaves: int = 31
    ridge: float = 0.0
    least_weight: float = 0.0
    least_rows: int = 1
    rows_share: float = 1.0
    features_share: float = 1.0
    columns: tuple[int, ...] = ()
    seed: int = 42

    @property
    def forest(self) -> bool:
        return self.family == "random_forest"

    @property
    def parts(self) -> int:
        """Sums a histogram needs: gradients, second derivatives and, where rows count apart from these, rows."""
        return 3 if self.logistic and not self.forest and self.least_rows > 1 else 2

    @property
    def step(self) -> float:
        """What a tree's leaf values are multiplied by; a forest takes the mean of its trees."""
        return 1.0 / self.trees if self.forest else self.rate


@dataclass
class Tree:
    feature: np.ndarray  # -1 at leaves
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node each row (columns of bins: features x rows) ends in.

        A small tree is gone through once, node by node with the rows that are in it; a large one level by level.
        """
        if np.count_nonzero(self.feature >= 0) > MASKED_NODES:
            node = np.zeros(bins.shape[1], np.int64)
            for _ in range(self.depth):
                node = step_down(self, bins, node)
            return node
        feature, threshold, missing_left, children = self.feature.tolist(), self.threshold.tolist(), self.missing_left.tolist(), list(zip(self.left.tolist(), self.right.tolist()))
        rows, leaves, place = {0: np.ones(bins.shape[1], bool)}, [], np.zeros(bins.shape[1], np.uint8)
        while rows:
            node, here = rows.popitem()
            if feature[node] < 0:
                place += here.view(np.uint8) * np.uint8(len(leaves))
                leaves.append(node)
                continue
            found = bins[feature[node]]
            left = here & (found <= threshold[node])
            if not missing_left[node]:
                left &= found > 0
            rows[children[node][0]], rows[children[node][1]] = left, here ^ left
        return np.array(leaves).take(place)


def step_down(tree: Tree | "Growth", bins: np.ndarray, node: np.ndarray) -> np.ndarray:
    feature = tree.feature[node]
    inner = np.flatnonzero(feature >= 0)
    at = node[inner]
    found = bins[feature[inner], inner]
    left = np.where(found == 0, tree.missing_left[at], found <= tree.threshold[at])
    out = node.copy()
    out[inner] = np.where(left, tree.left[at], tree.right[at])
    return out


def draws(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A uniform number per row (by its 64-bit hash) and tree."""
    with np.errstate(over="ignore"):
        x = row + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


#: Chances that a row is drawn at most 0, 1, 2 .. times when as many rows are drawn with replacement as there are.
_TIMES = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040]))


def row_weights(rules: Rules, row: np.ndarray, tree: int) -> np.ndarray:
    if rules.forest:
        return np.searchsorted(_TIMES, draws(row, tree, rules.seed), "right").astype(np.float64)
    return np.ones(len(row)) if rules.rows_share >= 1 else (draws(row, tree, rules.seed) < rules.rows_share).astype(np.float64)


def gradients(rules: Rules, y: np.ndarray, margin: np.ndarray, weight: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, times the row's weight, in whole multiples of ``1 / scale``."""
    if rules.forest:
        g, h = -y, np.ones(len(y))
    elif rules.logistic:
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1.0 - p)
    else:
        g, h = margin - y, np.ones(len(y))
    return np.rint(g * scale) * weight, np.rint(h * scale) * weight


def gradient_scale(largest: float) -> float:
    """A power of two that keeps gradients of labels up to ``largest`` within ``GRADIENT_BITS``."""
    return 2.0 ** (GRADIENT_BITS - max(0, int(np.ceil(np.log2(max(2.0 * largest, 1.0))))))


class Layout:
    """Where each (column, bin) has its cell in a histogram: columns differ in their number of bins."""

    def __init__(self, columns: tuple[int, ...], widths: list[int]):
        self.columns = columns
        size = np.array([widths[c] for c in columns], np.int64)
        self.first = np.cumsum(size) - size
        self.cells = int(size.sum())
        self.place = np.repeat(np.arange(len(columns)), size)  # of a cell: its column's place, and its bin
        self.bin = np.arange(self.cells) - self.first[self.place]
        self.values = self.bin > 0


def histogram(bins: np.ndarray, layout: Layout, slot: np.ndarray, k: int, weight: np.ndarray, parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sums of ``parts`` per open node (``slot`` of each row, -1 for none) and cell, over rows with a weight."""
    rows = np.flatnonzero((slot >= 0) & (weight > 0))
    whole = len(rows) == len(slot)
    if not whole:
        slot, parts = slot[rows], tuple(p[rows] for p in parts)
    out, ends = np.empty((len(parts), k, layout.cells)), [*layout.first[1:].tolist(), layout.cells]
    wide = max((hi - lo for lo, hi in zip(layout.first.tolist(), ends)), default=0)
    base = slot * wide
    for c, lo, hi in zip(layout.columns, layout.first.tolist(), ends):
        at = base + (bins[c] if whole else bins[c].take(rows))
        for s, values in enumerate(parts):
            out[s, :, lo:hi] = np.bincount(at, values, k * wide).reshape(k, wide)[:, :hi - lo]
    return out


def _score(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    weight = h + ridge if ridge else h
    return np.divide(g * g, weight, out=np.zeros_like(g), where=weight > 0)


@dataclass
class Growth:
    """A tree being grown. ``open``: the nodes whose histograms it waits for."""
    rules: Rules
    number: int
    scale: float = 1.0
    open: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        self.feature, self.threshold, self.left, self.right, self.level = (np.full(1, v, np.int64) for v in (-1, 0, 0, 0, 0))
        self.missing_left, self.sums = np.zeros(1, bool), np.zeros((1, 2))
        self.known: dict[int, tuple] = {}
        self.rounds, self.size = 0, 1

    def take(self, sums: np.ndarray, layout: Layout) -> None:
        """The histograms ([g, h, rows if needed], node, cell) of ``open``, in its order; opens the next nodes."""
        r, first = self.rules, layout.first
        planes = [sums[0] / self.scale, sums[1] / self.scale, *sums[2:r.parts]]
        end = first[1] if len(first) > 1 else layout.cells
        total = [x[:, :end].sum(1, keepdims=True) for x in planes]
        if not self.rounds:
            self.sums[0] = total[0][0, 0], total[1][0, 0]
        self.rounds += 1
        upto = [x.cumsum(1) for x in planes]
        upto = [u - u[:, first][:, layout.place] for u in upto]  # of the values up to a bin, without missing ones
        missing = [x[:, first][:, layout.place] for x in planes]
        some = bool(missing[1].any())
        sides = [True] if r.family == "catboost" else [False, True] if some else [False]  # missing values go left
        found = []
        for left in sides:
            a = [u + m for u, m in zip(upto, missing)] if left and some else upto
            b = [t - x for t, x in zip(total, a)]
            gain = _score(a[0], a[1], r.ridge) + _score(b[0], b[1], r.ridge) - _score(total[0], total[1], r.ridge)
            gain[:, ~layout.values] = -np.inf
            if r.family != "catboost":
                # a forest's second derivatives, and those of squares, are its rows
                least = max(1, r.least_rows) if r.parts == 3 or not r.logistic or r.forest else 1 / (2 * self.scale)
                fits = (a[-1] >= least) & (b[-1] >= least)
                if r.least_weight:
                    fits &= (a[1] >= r.least_weight) & (b[1] >= r.least_weight)
                gain[~fits] = -np.inf
            found.append((gain, left, a, b))
        if r.family == "catboost":
            self._level(*found[0], layout)
            return
        if r.features_share < 1:
            n = len(first)
            kept = max(1, int(round(r.features_share * n)))
            order = np.random.default_rng((r.seed, self.number, self.rounds)).random((len(self.open), n)).argsort(1)
            left_out = np.zeros((len(self.open), n), bool)
            np.put_along_axis(left_out, order[:, kept:], True, 1)
            for gain, *_ in found:
                gain[left_out[:, layout.place]] = -np.inf
        best = [f[0].argmax(1) for f in found]
        top = np.stack([f[0][np.arange(len(b)), b] for f, b in zip(found, best)])
        for i, (node, side) in enumerate(zip(self.open, top.argmax(0).tolist())):
            cell, (_, left, a, b) = best[side][i], found[side]
            self.known[node] = (float(top[side, i]), int(layout.place[cell]), int(layout.bin[cell]), left, (a[0][i, cell], a[1][i, cell]), (b[0][i, cell], b[1][i, cell]))
        self._best_first() if r.family == "lightgbm" else self._each()

    def _split(self, node: int, place: int, threshold: int, missing_left: bool, left: tuple, right: tuple) -> tuple[int, int]:
        a = self.size
        if a + 2 > len(self.feature):
            for name in ("feature", "threshold", "left", "right", "level", "missing_left", "sums"):
                old = getattr(self, name)
                new = np.zeros((2 * len(old) + 2, *old.shape[1:]), old.dtype)
                new[:len(old)] = old
                setattr(self, name, new)
        self.feature[node], self.threshold[node], self.missing_left[node] = self.rules.columns[place], threshold, missing_left
        self.left[node], self.right[node] = a, a + 1
        self.feature[a:a + 2], self.level[a:a + 2] = -1, self.level[node] + 1
        self.sums[a], self.sums[a + 1] = left, right
        self.size += 2
        return a, a + 1

    def _deeper(self, nodes: list[int]) -> list[int]:
        return [n for n in nodes if self.level[n] < self.rules.depth]

    def _each(self) -> None:
        """Depth-wise: every node that gains is split."""
        born: list[int] = []
        for node in self.open:
            gain, *how = self.known[node]
            if gain > _LEAST_GAIN:
                born += self._split(node, *how)
        self.open = self._deeper(born)

    def _level(self, gain: np.ndarray, missing_left: bool, left: list[np.ndarray], right: list[np.ndarray], layout: Layout) -> None:
        """Symmetric: the feature and threshold with the largest gain over all nodes of the level split each of them."""
        summed = gain.sum(0)
        cell = int(summed.argmax())
        born: list[int] = []
        if summed[cell] > _LEAST_GAIN:
            for i, node in enumerate(self.open):
                born += self._split(node, int(layout.place[cell]), int(layout.bin[cell]), missing_left, (left[0][i, cell], left[1][i, cell]), (right[0][i, cell], right[1][i, cell]))
        self.open = self._deeper(born)

    def _best_first(self) -> None:
        """Leaf-wise: the leaf with the largest gain is split next, up to ``leaves`` of them.

        Played through with the gains known so far; children whose gain is unknown are opened, and the play is
        repeated when it is. The last play knows all gains it meets.
        """
        heap = [(-self.known[0][0], 0)]
        self.chosen, unknown, leaves = set(), [], 1
        while heap and leaves < self.rules.leaves:
            less, node = heapq.heappop(heap)
            if -less <= _LEAST_GAIN:
                break
            self.chosen.add(node)
            leaves += 1
            children = [int(self.left[node]), int(self.right[node])] if self.feature[node] >= 0 else self._split(node, *self.known[node][1:])
            for child in self._deeper(list(children)):
                if child in self.known:
                    heapq.heappush(heap, (-self.known[child][0], child))
                else:
                    unknown.append(child)
        self.open = unknown

    def tree(self) -> Tree:
        """The grown tree; nodes that were split on trial only are leaves."""
        n = self.size
        feature, sums = self.feature[:n], self.sums[:n]
        if self.rules.family == "lightgbm":
            feature = np.where(np.isin(np.arange(len(feature)), list(self.chosen)), feature, -1)
        weight = sums[:, 1] + self.rules.ridge
        value = -np.divide(sums[:, 0], weight, out=np.zeros(len(weight)), where=weight > 0)
        return Tree(feature, self.threshold[:n], self.missing_left[:n], self.left[:n], self.right[:n], value, int(self.level[:n].max()))


def base_margin(rules: Rules, mean: float) -> float:
    if rules.forest:
        return 0.0
    if not rules.logistic:
        return mean
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


def predicted(rules: Rules, margin: np.ndarray) -> np.ndarray:
    """Probabilities, or values, of margins."""
    return 1.0 / (1.0 + np.exp(-margin)) if rules.logistic and not rules.forest else margin


def fit_here(rules: Rules, bins: np.ndarray, y: np.ndarray, row: np.ndarray, widths: list[int]) -> tuple[float, list[Tree]]:
    """All trees of one setting on rows that are here: the same trees as ``boosting.grow`` gives."""
    base, scale = base_margin(rules, float(y.mean())), gradient_scale(float(np.abs(y).max(initial=0.0)))
    margin, trees, layout = np.full(len(y), base), [], Layout(rules.columns, widths)
    for number in range(rules.trees):
        weight = row_weights(rules, row, number)
        g, h = gradients(rules, y, margin, weight, scale)
        growth, node = Growth(rules, number, scale), np.zeros(len(y), np.int64)
        while growth.open:
            slot_of = np.full(len(growth.feature), -1)
            slot_of[growth.open] = np.arange(len(growth.open))
            growth.take(histogram(bins, layout, slot_of[node], len(growth.open), weight, (g, h, weight)[:rules.parts]), layout)
            node = step_down(growth, bins, node)
        trees.append(growth.tree())
        if not rules.forest:
            margin = margin + rules.step * trees[-1].value[trees[-1].leaf(bins) if rules.family == "lightgbm" else node]
    return base, trees
