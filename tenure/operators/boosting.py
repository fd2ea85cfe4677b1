"""Boosted families and forests on Spark (M6, M7).

``grow`` fits any number of models (settings x left-out folds) together: rows are binned once into blocks, and one
pass over the blocks per tree level sums gradients per (model, node, feature, bin) by a grouped aggregate. What
reaches the driver is bounded by nodes x features x bins, not by rows. Margins are written with the blocks every
``REFRESH`` trees, so a pass evaluates a few trees only and a lost executor costs its tasks.

``tune`` tries many settings on a sample of ``TUNE_ROWS`` rows, the bound that the search has by definition: one task
per (trial, fold) grows a whole model from the same histograms, all trials of a round side by side, and a
tree-structured Parzen estimator proposes the next round.

The families differ as their libraries do. ``lightgbm`` grows leaf-wise to a number of leaves; ``xgboost`` level by
level with a ridge on second-order gains, row draws per tree and a learned side for missing values; ``catboost``
symmetric trees over ordered target statistics of the categories; ``random_forest`` bootstraps rows and draws features
per node. Missing numbers are not imputed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.operators.encode import apply_codes, code_dictionary, column_kinds
from tenure.operators.quantiles import column_quantiles
from tenure.operators.ranking import running_sums
from tenure.operators.sampling import hash32, seeded_sample
from tenure.operators.trees import Growth, Layout, Rules, Tree, base_margin, fit_here, gradient_scale, gradients, histogram, predicted, row_weights
from tenure.session import cut_lineage

BINS = 64
BLOCK_ROWS = 16_384
PASS_CELLS = 100_000
#: Sums of a histogram that go through the shuffle as one row.
PIECE = 1 << 13
REFRESH = 10
TUNE_ROWS = 30_000
SEED = 42

# Each family's own defaults (the tree counts and depths are those of the analysis scripts).
FAMILIES = {
    "lightgbm": {"trees": 100, "depth": 5, "rate": 0.1, "leaves": 31, "least_weight": 1e-3, "least_rows": 20},
    "xgboost": {"trees": 100, "depth": 5, "rate": 0.3, "ridge": 1.0, "least_weight": 1.0},
    "catboost": {"trees": 100, "depth": 6, "rate": 0.1, "ridge": 3.0},
    "random_forest": {"trees": 100, "depth": 10},
}
# The bounds of each family's search (integers, or decimals; rates are drawn on a log scale).
SEARCH = {
    "random_forest": {"trees": (100, 300), "depth": (8, 15), "least_rows": (1, 4), "features_share": (0.7, 1.0)},
    "lightgbm": {"trees": (100, 350), "depth": (3, 8), "rate": (0.01, 0.15), "leaves": (30, 100)},
    "xgboost": {"trees": (100, 350), "depth": (3, 8), "rate": (0.01, 0.15), "rows_share": (0.6, 0.95)},
    "catboost": {"trees": (100, 350), "depth": (3, 8), "rate": (0.01, 0.15)},
}
LOG_SCALE = ("rate",)
TRIALS = 20


def rules(family: str, logistic: bool, columns: Sequence[int], **settings) -> Rules:
    return Rules(family, logistic, **{**FAMILIES[family], **settings, "columns": tuple(columns)})


# ---------------------------------------------------------------- preparation
@dataclass
class Columns:
    """How rows become bins: codes of the categories, their target statistics, and each column's cut points."""
    numeric: list[str]
    categorical: list[str]
    dictionary: DataFrame
    totals: DataFrame  # column, value, s, n: label sums per category
    prior: float
    label: str
    cuts: dict[str, list[float]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical, *[f"ts {c}" for c in self.categorical]]

    def of(self, family: str) -> list[int]:
        """The columns a family splits on: codes, or for catboost target statistics."""
        n, k = len(self.numeric), len(self.categorical)
        return [*range(n), *(range(n + k, n + 2 * k) if family == "catboost" else range(n, n + k))]

    @property
    def widths(self) -> list[int]:
        return [len(c) + 2 for c in self.cuts.values()]

    def coded(self, df: DataFrame) -> DataFrame:
        """Rows with codes, and the target statistics of all training rows (for rows that were not trained on)."""
        values = _long(df, self.categorical).join(self.totals, ["column", "value"], "left")
        return apply_codes(_with(df, values, self.categorical, _statistic(F.col("s"), F.col("n"), self.prior)), self.categorical, self.dictionary)

    def ordered(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Training rows with codes, and ordered target statistics: of the rows of the category that come before, by hash."""
        values = _long(df.withColumn("_h", hash32(list(keys), SEED)), self.categorical, "_h", F.col(self.label).cast("double").alias("y"))
        sums = running_sums(values.withColumn("one", F.lit(1)), ["_h", "_row"], ["y", "one"], group_cols=["column", "value"])
        before = _statistic(F.col("cum_y") - F.col("y"), F.col("cum_one") - 1, self.prior)
        return apply_codes(_with(df, sums, self.categorical, before), self.categorical, self.dictionary)


def _long(df: DataFrame, categorical: Sequence[str], *more) -> DataFrame:
    """A row per row and category column: its value as text (null: a category of its own)."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias("value")) for c in categorical]) \
        if categorical else F.array().cast("array<struct<column: string, value: string>>")
    return df.select("_row", *more, F.explode(items).alias("_i")).select("_row", "_i.*", *[m if isinstance(m, str) else "y" for m in more])


def _statistic(s, n, prior: float):
    return (F.coalesce(s, F.lit(0.0)) + prior) / (F.coalesce(n, F.lit(0)) + 1)


def _with(df: DataFrame, values: DataFrame, categorical: Sequence[str], statistic) -> DataFrame:
    if not categorical:
        return df
    wide = values.withColumn("_ts", statistic).groupBy("_row").agg(*[F.max(F.when(F.col("column") == c, F.col("_ts"))).alias(f"ts {c}") for c in categorical])
    return df.join(wide, "_row")


def numbered(df: DataFrame) -> DataFrame:
    """Rows with a number of their own, written so that it stays."""
    return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))


def prepare(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str]) -> tuple[Columns, DataFrame]:
    """Columns fitted on ``train`` (rows of ``numbered``), and its rows with codes and ordered statistics."""
    kinds = column_kinds(train, list(features))
    cat, num = ([f for f in features if kinds[f] == k] for k in ("categorical", "numeric"))
    prior = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    totals = _long(train, cat, F.col(label).cast("double").alias("y")).groupBy("column", "value").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    cols = Columns(num, cat, cut_lineage(code_dictionary(train, cat)), cut_lineage(totals), float(prior), label)
    rows = cut_lineage(cols.ordered(train, keys))
    probs = [i / (BINS - 1) for i in range(BINS - 1)]
    got = column_quantiles(rows, {f"`{c}`" if " " in c else c: probs for c in cols.names})
    cols.cuts = {c: sorted({v for v in got[f"`{c}`" if " " in c else c] if v is not None})[:-1] for c in cols.names}
    return cols, rows


def to_bins(pdf: pd.DataFrame, cuts: Mapping[str, Sequence[float]]) -> np.ndarray:
    """Bins (columns x rows): 0 for missing values, else one more than the cut points below the value."""
    out = np.zeros((len(cuts), len(pdf)), np.uint8)
    for j, (c, at) in enumerate(cuts.items()):
        v = pdf[c].to_numpy(np.float64, na_value=np.nan)
        out[j] = np.where(np.isnan(v), 0, np.searchsorted(np.array(at, float), v, "left") + 1)
    return out


# ---------------------------------------------------------------- joint growth
@dataclass
class Fitted:
    rules: Rules
    base: float
    trees: list[Tree] = field(default_factory=list)
    left_out: int | None = None

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.base)
        for tree in self.trees:
            out += self.rules.step * tree.value[tree.leaf(bins)]
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return predicted(self.rules, self.margin(bins))


_BLOCK = "bins binary, y binary, fold binary, row binary, margin binary"


def _blocks(rows: DataFrame, columns: Columns, keys: Sequence[str], fold: str | None, n: int) -> DataFrame:
    """The rows as blocks of about ``BLOCK_ROWS``; few rows are one block, whose sums need no shuffle.

    At most three partitions per core, and more than one per core only of five blocks or more each: a pass sends one sum
    per cell from each partition, and each task of a pass takes as long to begin as a block or two to sum.
    """
    cuts = columns.cuts
    names = [f"_{j}" for j in range(len(cuts))]
    slim = rows.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cuts, names)], F.col(columns.label).cast("double").alias("_y"),
                       (F.col(fold) if fold else F.lit(-1)).cast("int").alias("_fold"), F.xxhash64(*keys).alias("_id")).where("_y IS NOT NULL")

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for pdf in chain(parts, [None]):
            waiting += [] if pdf is None else [pdf]
            if not waiting or pdf is not None and sum(map(len, waiting)) < BLOCK_ROWS:
                continue
            joined, waiting = pd.concat(waiting), []
            for lo in range(0, len(joined), BLOCK_ROWS):
                some = joined.iloc[lo:lo + BLOCK_ROWS]
                bins = to_bins(some, dict(zip(names, cuts.values())))
                yield pd.DataFrame({"bins": [bins.tobytes()], "y": [some["_y"].to_numpy(np.float64).tobytes()], "fold": [some["_fold"].to_numpy(np.int32).tobytes()],
                                    "row": [some["_id"].to_numpy(np.int64).tobytes()], "margin": [b""]})
    blocks, cores = -(-n // BLOCK_ROWS), rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(blocks, max(cores, min(blocks // 5, 3 * cores))))
    return (slim.coalesce(1) if parts == 1 else slim.repartition(parts)).mapInPandas(pack, _BLOCK)


def _block(values: Sequence[bytes], models: list[Fitted]) -> tuple[np.ndarray, ...]:
    bins, y, fold, row, margin = values
    y = np.frombuffer(y, np.float64)
    bins, fold, row = np.frombuffer(bins, np.uint8).reshape(-1, len(y)), np.frombuffer(fold, np.int32), np.frombuffer(row, np.int64).view(np.uint64)
    base = np.frombuffer(margin, np.float64).reshape(len(models), -1) if margin else np.array([[m.base] for m in models]) + np.zeros(len(y))
    return bins, y, fold, row, base


def grow(rows: DataFrame, columns: Columns, settings: Sequence[Rules], keys: Sequence[str], fold: str | None = None,
         left_out: Sequence[int | None] | None = None) -> list[Fitted]:
    """Fit every setting on ``rows`` (of ``prepare``), without its ``left_out`` fold, all together: one pass per tree level."""
    models = [Fitted(s, 0.0, left_out=f) for s, f in zip(settings, left_out or [None] * len(settings))]
    y = F.col(columns.label).cast("double")
    by_fold = rows.where(y.isNotNull()).groupBy((F.col(fold) if fold else F.lit(-1)).alias("f")).agg(F.sum(y).alias("s"), F.count(y).alias("n"), F.max(F.abs(y)).alias("m")).collect()
    blocks = cut_lineage(_blocks(rows, columns, keys, fold, sum(r["n"] for r in by_fold)))
    scale = gradient_scale(max((r["m"] for r in by_fold), default=0.0))
    for m in models:
        mine = [r for r in by_fold if r["f"] != m.left_out or m.left_out is None]
        m.base = base_margin(m.rules, sum(r["s"] for r in mine) / max(1, sum(r["n"] for r in mine)))
    done = 0  # trees whose margins the blocks hold
    for number in range(max(s.trees for s in settings)):
        growing = {i: Growth(m.rules, number, scale) for i, m in enumerate(models) if number < m.rules.trees}
        while any(g.open for g in growing.values()):
            for i, sums in _pass(blocks, models, growing, done, columns.widths, scale).items():
                growing[i].take(*sums)
        for i, g in growing.items():
            models[i].trees.append(g.tree())
        if (number + 1) % REFRESH == 0:
            blocks, done = cut_lineage(_refreshed(blocks, models, done)), number + 1
    return models


def _recent(m: Fitted, done: int, bins: np.ndarray, base: np.ndarray) -> np.ndarray:
    for tree in m.trees[done:]:
        base = base + m.rules.step * tree.value[tree.leaf(bins)]
    return base


def _refreshed(blocks: DataFrame, models: list[Fitted], done: int) -> DataFrame:
    def refresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                bins, _, _, _, base = _block(values, models)
                margin = np.stack([_recent(m, done, bins, base[i]) for i, m in enumerate(models)])
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (*values[:4], margin.tobytes())], batch.schema.names)
    return blocks.mapInArrow(refresh, _BLOCK)


def _pass(blocks: DataFrame, models: list[Fitted], growing: dict[int, Growth], done: int, widths: list[int], scale: float) -> dict[int, tuple]:
    """Histograms of all open nodes of all models, from one pass over the blocks."""
    active = {i: g for i, g in growing.items() if g.open}
    layouts = {i: Layout(g.rules.columns, widths) for i, g in active.items()}
    shapes = {i: (g.rules.parts, len(g.open), layouts[i].cells) for i, g in active.items()}
    pieces = {i: -(-math.prod(s) // PIECE) for i, s in shapes.items()}
    first = dict(zip(shapes, np.cumsum([0, *pieces.values()]).tolist()))
    recent = [replace_trees(m, done) for m in models]
    # a task walks rows down what is grown so far; what the growing trees know of their nodes stays here
    grown = {i: (g.number, g.open, Tree(g.feature, g.threshold, g.missing_left, g.left, g.right, np.zeros(0), int(g.level.max()))) for i, g in active.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                bins, y, fold, row, base = _block(values, recent)
                for i, (number, opened, tree) in grown.items():
                    m = recent[i]
                    weight = row_weights(m.rules, row, number)
                    if m.left_out is not None:
                        weight = np.where(fold == m.left_out, 0.0, weight)
                    gr, he = gradients(m.rules, y, _recent(m, 0, bins, base[i]), weight, scale)
                    slot_of = np.full(len(tree.feature), -1)
                    slot_of[opened] = np.arange(len(opened))
                    got = histogram(bins, layouts[i], slot_of[tree.leaf(bins)], len(opened), weight, (gr, he, weight)[:m.rules.parts]).astype(np.int64)
                    total[i] = total[i] + got if i in total else got
        for i, got in total.items():
            flat = got.ravel()
            for p, lo in enumerate(range(0, len(flat), PIECE)):
                yield pa.RecordBatch.from_arrays([pa.array([first[i] + p], pa.int64()), pa.array([flat[lo:lo + PIECE].tobytes()], pa.binary())], ["piece", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, some in zip(batch.column("piece").to_pylist(), batch.column("sums")):
                got = np.frombuffer(some.as_buffer(), np.int64)
                total[piece] = total[piece] + got if piece in total else got.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["piece", "sums"])

    # each task has summed its own cells: they are dealt once, in pieces, to as few tasks as their number asks for
    parts = -(-sum(map(math.prod, shapes.values())) // PASS_CELLS)
    dealt = blocks.mapInArrow(sums, "piece long, sums binary").repartition(parts, "piece")
    found = dealt.mapInArrow(add, "piece long, sums binary").toArrow().to_pydict()
    values = {p: np.frombuffer(v, np.int64) for p, v in zip(found["piece"], found["sums"])}
    out = {}
    for i, shape in shapes.items():
        flat = [values[p] for p in range(first[i], first[i] + pieces[i]) if p in values]  # without rows there are none
        out[i] = (np.concatenate(flat).astype(np.float64) if flat else np.zeros(math.prod(shape))).reshape(shape), layouts[i]
    return out


def replace_trees(m: Fitted, done: int) -> Fitted:
    """The model with the trees from ``done`` on only: what a pass needs besides the written margins."""
    return replace(m, trees=m.trees[done:])


def scored(df: DataFrame, columns: Columns, models: Mapping[str, Fitted]) -> DataFrame:
    """``df`` (rows of ``numbered``) with a score per model; categories have the statistics of all training rows."""
    cuts, names = columns.cuts, [f"_{j}" for j in range(len(columns.cuts))]
    rows = columns.coded(df).select("_row", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cuts, names)])

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            bins = to_bins(pdf, dict(zip(names, cuts.values())))
            yield pd.DataFrame({"_row": pdf["_row"]} | {f"_s{i}": m.predict(bins) for i, m in enumerate(models.values())})
    got = rows.mapInPandas(predict, "_row long, " + ", ".join(f"_s{i} double" for i in range(len(models))))
    return df.join(got, "_row").withColumnsRenamed({f"_s{i}": name for i, name in enumerate(models)})


# ---------------------------------------------------------------- search
class Parzen:
    """Tree-structured Parzen estimator: per parameter the densities of good and of other settings, and the draw with the largest ratio."""

    def __init__(self, bounds: Mapping[str, tuple], seed: int = SEED, startup: int = 10, good_share: float = 0.25, candidates: int = 24):
        self.bounds, self.startup, self.good_share, self.candidates = dict(sorted(bounds.items())), startup, good_share, candidates
        self.rng = np.random.default_rng(seed)
        self.tried: list[tuple[dict, float]] = []

    def tell(self, settings: dict, value: float | None) -> None:
        self.tried.append((settings, -math.inf if value is None or math.isnan(value) else value))

    def ask(self) -> dict:
        return {p: self._back(p, self._draw(p)) for p in self.bounds}

    def _ends(self, p: str) -> tuple[float, float]:
        low, high = self.bounds[p]
        if isinstance(low, int):
            return low - 0.5, high + 0.5
        return (math.log(low), math.log(high)) if p in LOG_SCALE else (low, high)

    def _back(self, p: str, x: float) -> int | float:
        low, high = self.bounds[p]
        if isinstance(low, int):
            return int(min(high, max(low, round(x))))
        return round(min(high, max(low, math.exp(x) if p in LOG_SCALE else x)), 4)

    def _draw(self, p: str) -> float:
        low, high = self._ends(p)
        if len(self.tried) < self.startup:
            return self.rng.uniform(low, high)
        best = sorted(range(len(self.tried)), key=lambda i: -self.tried[i][1])
        cut = max(1, math.ceil(self.good_share * len(best)))
        value = lambda i: math.log(self.tried[i][0][p]) if p in LOG_SCALE else float(self.tried[i][0][p])
        good, rest = (np.sort([value(i) for i in part]) for part in (best[:cut], best[cut:]))
        kernels = [self._kernels(part, low, high) for part in (good, rest)]
        at = self.rng.integers(0, len(kernels[0][0]), self.candidates)
        x = np.clip(self.rng.normal(kernels[0][0][at], kernels[0][1][at]), low, high)
        ratio = self._density(x, kernels[0], low, high) - self._density(x, kernels[1], low, high)
        return float(x[ratio.argmax()])

    @staticmethod
    def _kernels(x: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """A normal kernel per value, as wide as the larger gap to a neighbour, and a wide one over all."""
        edges = np.concatenate([[low], x, [high]])
        gap = np.diff(edges)
        width = np.clip(np.maximum(gap[:-1], gap[1:]), (high - low) / min(100, len(x) + 1), high - low)
        return np.append(x, (low + high) / 2), np.append(width, high - low)

    @staticmethod
    def _density(x: np.ndarray, kernels: tuple[np.ndarray, np.ndarray], low: float, high: float) -> np.ndarray:
        at, width = kernels
        inside = np.array([math.erf((high - a) / w / math.sqrt(2)) - math.erf((low - a) / w / math.sqrt(2)) for a, w in zip(at, width)]) / 2
        each = np.exp(-0.5 * ((x[:, None] - at) / width) ** 2) / (width * inside)
        return np.log(each.mean(1) + 1e-300)


def average_precision(y: np.ndarray, value: np.ndarray) -> float | None:
    """Step sum over distinct scores, as ``metrics.ap_auc`` has it."""
    if not y.sum():
        return None
    order = np.argsort(-value, kind="stable")
    last = np.flatnonzero(np.append(np.diff(value[order]) != 0, True))
    hits = np.cumsum(y[order])[last]
    return float((np.diff(hits, prepend=0) * hits / (last + 1)).sum() / y.sum())


def r_squared(y: np.ndarray, value: np.ndarray) -> float | None:
    spread = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - np.maximum(value, 0)) ** 2).sum() / spread) if spread else None


def ordered_here(codes: np.ndarray, y: np.ndarray, row: np.ndarray, prior: float) -> np.ndarray:
    """Ordered target statistics of rows that are here: the label's mean over earlier rows of the category, in hashed order."""
    order = np.lexsort((row, codes))
    c, t = codes[order], y[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    each = np.diff(np.r_[first, len(c)])
    before = np.cumsum(t) - t
    n = np.arange(len(c)) - np.repeat(first, each)
    out = np.empty(len(c))
    out[order] = (before - np.repeat(before[first], each) + prior) / (n + 1)
    return out


def _fold_score(setting: Rules, fold: int, data: dict) -> float | None:
    """Fit one setting on all folds but one, and score that one."""
    held = data["fold"] == fold
    y, row, k = data["y"], data["row"], len(data["numeric"])
    bins = data["bins"]
    if setting.family == "catboost":
        prior, stats = float(y[~held].mean()), np.zeros((len(bins) - k, len(y)))
        for j, codes in enumerate(bins[k:]):
            mine, n = np.bincount(codes[~held], y[~held], 256), np.bincount(codes[~held], minlength=256)
            stats[j] = ((mine + prior) / (n + 1))[codes]
            cuts = np.unique(np.quantile(ordered := ordered_here(codes[~held], y[~held], row[~held], prior), np.linspace(0, 1, BINS - 1)))[:-1]
            stats[j, ~held] = ordered
            stats[j] = np.searchsorted(cuts, stats[j], "left") + 1
        bins = np.concatenate([bins[:k], stats.astype(np.uint8)])
    widths = (bins.max(1).astype(int) + 1).tolist()
    model = Fitted(setting, *fit_here(setting, bins[:, ~held], y[~held], row[~held], widths))
    value = model.predict(bins[:, held])
    return average_precision(y[held], value) if setting.logistic else r_squared(y[held], value)


def tuning_sample(rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], fold: str, n: int = TUNE_ROWS) -> dict:
    """At most ``n`` rows, binned, for trials that run in tasks."""
    kinds = column_kinds(rows, list(features))
    cat, num = ([f for f in features if kinds[f] == k] for k in ("categorical", "numeric"))
    some = seeded_sample(rows.where(F.col(label).isNotNull()), n, list(keys), SEED)
    coded = apply_codes(some, cat, code_dictionary(rows, cat))
    pdf = coded.select(*[F.col(c).cast("double").alias(c) for c in [*num, *cat]], F.col(label).cast("double").alias("_y"), F.col(fold).cast("int").alias("_fold"),
                       F.xxhash64(*keys).alias("_id")).toPandas().sort_values("_id")
    cuts = {c: sorted(set(np.nanquantile(pdf[c].to_numpy(float), np.linspace(0, 1, BINS - 1)).tolist()))[:-1] if pdf[c].notna().any() else [] for c in num}
    cuts |= {c: sorted(pdf[c].unique().tolist())[:BINS - 1] for c in cat}
    return {"bins": to_bins(pdf, cuts), "y": pdf["_y"].to_numpy(float), "fold": pdf["_fold"].to_numpy(), "row": pdf["_id"].to_numpy(np.int64).view(np.uint64), "numeric": num}


def tune(spark, data: dict, family: str, logistic: bool, n_trials: int = TRIALS, bounds: Mapping[str, tuple] | None = None, startup: int = 10,
         round_size: int = 5) -> tuple[dict, list[dict]]:
    """M7: the best setting by mean fold score, and every trial. Each round of trials is a job with a task per (trial, fold)."""
    search = Parzen(bounds or SEARCH[family], startup=startup)
    folds = sorted(set(data["fold"].tolist()))
    sent = spark.sparkContext.broadcast(data)  # at most TUNE_ROWS binned rows
    columns = range(len(data["bins"]))
    trials: list[dict] = []
    while len(trials) < n_trials:
        size = min(n_trials - len(trials), startup if len(trials) < startup else round_size)
        asked = [search.ask() for _ in range(size)]
        units = [(t, f) for t in range(size) for f in folds]
        settings = [rules(family, logistic, columns, **s) for s in asked]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                got = [(int(i), _fold_score(settings[units[i][0]], units[i][1], sent.value)) for i in pdf["id"]]
                yield pd.DataFrame(got, columns=["id", "score"])
        scores = {r["id"]: r["score"] for r in spark.range(0, len(units), 1, len(units)).mapInPandas(run, "id long, score double").collect()}
        for t, s in enumerate(asked):
            each = [scores[i] for i, (trial, _) in enumerate(units) if trial == t]
            known = [x for x in each if x is not None and not math.isnan(x)]
            mean = sum(known) / len(known) if known else None
            search.tell(s, mean)
            trials.append({"params": s, "mean": mean, "folds": each})
    sent.unpersist()
    best = max(trials, key=lambda t: -math.inf if t["mean"] is None else t["mean"])
    return best["params"], trials
