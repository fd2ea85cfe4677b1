"""Operator 13, whitening by Chebyshev-filtered subspace iteration.

Entries become whole numbers x = floor(64 c) + 1000000; V is the covariance of the x-vectors (divisor n). V is never
formed: a pass over the rows gives V Q = XᵀXQ / n for a block Q, centred before multiplying, as per-task sums that a
grouped sum adds up. The block holds the wanted components and ``GUARD`` more. Each round applies a Chebyshev
polynomial of V (a three-term recurrence, a pass per degree) that stays small between 0 and the block's smallest
Ritz value, the unwanted spectrum, and grows fast above; then QR and Rayleigh-Ritz. Rounds go on until every wanted
component v is certified, |V v - e v| <= ``TOLERANCE`` times the largest eigenvalue, and its residual no longer
falls, which is where double precision ends.

Only d x block matrices (d: the vectors' length) pass the driver; rows stay where they are, and each pass reads the
written rows again, so a lost executor costs its tasks only.

Defined cases: rows whose vector is null, empty, or holds null, non-finite or huge (2^40 and over) entries are
dropped; zero vectors stay. Vectors of another length than the most frequent one (ties: the longest) cannot share a
covariance and are dropped. Null and repeated ids are rows like others. Components with no variance (under
``NO_VARIANCE`` of the largest) have no whitened values and are left out, so copies of a single vector give no rows, as
does an empty table. ``deviation`` is null where the exact sum does not fit a long. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.shared import written

COMPONENTS = 32
GUARD = 16
DEGREE = 10
ROUNDS = 60
TOLERANCE = 1e-12
NO_VARIANCE = 1e-10
SCALE = 64
SEED = 13
ROWS_OUT = 2048
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fitted:
    """Components (d x k, unit columns) and their eigenvalues, falling; what they were fitted on."""
    n: int
    sums: list[int]  # of floor(64 c), exact
    largest: int  # absolute floor(64 c)
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float  # largest |V v - e v| over the largest e
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def whole_entries(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and y = floor(64 c) of the usable rows, written; all of one length. (x is y + 1000000, the same once centred.)"""
    v = F.col(vector).cast("array<double>")
    fit = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 40)))
    got = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("_v"), F.coalesce(fit, F.lit(False)).alias("_fit")).where("_fit AND size(_v) > 0")
    got = written(got.select("vec_id", F.transform("_v", lambda c: F.floor(c * SCALE).cast("long")).alias("y")), "whole-entries")
    lengths = got.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return got.where(F.size("y") == (lengths["d"] if lengths else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(rows: DataFrame) -> tuple[int, list[int], int]:
    """Row count, exact sums per dimension, largest absolute entry."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(y.shape[1], dtype=np.int32)), pa.array([Decimal(int(s)) for s in y.sum(0)], pa.decimal128(38, 0)),
                     pa.array(np.abs(y).max(0)), pa.array(np.full(y.shape[1], len(y)))], ["i", "s", "m", "n"])
    got = (rows.select("y").mapInArrow(partial, "i int, s decimal(38,0), m long, n long")
           .groupBy("i").agg(F.sum("s").alias("s"), F.max("m").alias("m"), F.sum("n").alias("n")).orderBy("i").collect())
    return (int(got[0]["n"]) if got else 0), [int(r["s"]) for r in got], max((r["m"] for r in got), default=0)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``part(y)``, a matrix of ``shape``: added up per task, then by a grouped sum."""
    names = [f"c{j}" for j in range(shape[1])]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(_matrix(batch))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), *(pa.array(total[:, j]) for j in range(shape[1]))], ["i", *names])
    sums = rows.select("y").mapInArrow(partial, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros(shape)
    for r in sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["i"]] = r[1:]
    return out


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], x: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of ``apply`` on ``x``: small on [low, cut], about 1 at ``top``."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = half / (top - middle)
    tau = 2 / sigma
    y = (apply(x) - middle * x) * (sigma / half)
    for _ in range(degree - 1):
        next_sigma = 1 / (tau - sigma)
        x, y = y, 2 * (apply(y) - middle * y) * (next_sigma / half) - sigma * next_sigma * x
        sigma = next_sigma
    return y


def subspace(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS,
             seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of the positive semi-definite ``apply``, their vectors, and the largest relative residual."""
    k, block = min(k, d), min(d, k + guard)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    before = np.inf
    for _ in range(rounds):
        w = apply(q)
        h = q.T @ w
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, vx = q @ turn, w @ turn
        top = float(values[0])
        if top <= 0:
            return np.zeros(0), np.zeros((d, 0)), 0.0
        wanted = np.flatnonzero(values[:k] > NO_VARIANCE * top)
        residual = float(np.sqrt(((vx - x * values) ** 2).sum(0))[wanted].max() / top)
        if residual <= TOLERANCE and (residual <= 1e-15 or residual > 0.3 * before):
            x = x[:, wanted]
            x = x * np.where(np.take_along_axis(x, np.abs(x).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)
            return values[wanted], x / np.sqrt((x * x).sum(0)), residual
        before = residual
        cut = max(float(values[-1]), 0.0)
        low = min(0.0, cut - 1e-3 * top)
        if block < d:
            q = np.linalg.qr(chebyshev(apply, x, degree, low, min(cut, 0.999 * top), top))[0]
        else:  # the block is the whole space: nothing unwanted is left to damp
            q = np.linalg.qr(x)[0]
    raise RuntimeError(f"not certified after {rounds} rounds: residual {before:.1e}")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fitted | None:
    """The components of ``whole_entries``; None where there are no rows."""
    n, sums, largest = _sums(rows)
    if not n:
        return None
    d, passes = len(sums), [0]
    model = Fitted(n, sums, largest, 0.0, np.zeros(0), np.zeros((d, 0)), 0.0, 0)
    mean = model.mean
    model.trace = float(_summed(rows, lambda y: ((y - mean) ** 2).sum(0)[:, None], (d, 1)).sum()) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def part(y: np.ndarray) -> np.ndarray:
            centred = y - mean
            return centred.T @ (centred @ q)
        passes[0] += 1
        return _summed(rows, part, q.shape) / n

    model.values, model.vectors, model.residual = subspace(apply, d, components)
    model.passes = passes[0]
    return model


def identity_error(rows: DataFrame, model: Fitted) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from one more pass."""
    k = len(model.values)
    mean, turn = model.mean, model.vectors / np.sqrt(model.values)

    def part(y: np.ndarray) -> np.ndarray:
        z = np.column_stack([(y - mean) @ turn, np.ones(len(y))])
        return z.T @ z
    sums = _summed(rows, part, (k + 1, k + 1)) / model.n
    return float(np.abs(sums[:k, :k] - np.outer(sums[:k, k], sums[:k, k]) - np.eye(k)).max(initial=0))


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    entries = whole_entries(rows, id_col, vector)
    model = fit(entries, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    error, k, d = identity_error(entries, model), len(model.values), len(model.sums)
    mean, turn, explained = model.mean, model.vectors / np.sqrt(model.values), model.values / model.trace
    n, sums, fits = model.n, model.sums, d * (2 * model.n * max(1, model.largest)) ** 2 < 1 << 62

    def deviations(y: np.ndarray) -> pa.Array:
        if fits:
            return pa.array(((n * y - np.array(sums, np.int64)) ** 2).sum(1))
        exact = ((n * y.astype(object) - np.array(sums, object)) ** 2).sum(1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(lo, ROWS_OUT)
                y = _matrix(part)
                m, each = len(y), np.repeat(np.arange(len(y)), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     deviations(y).take(pa.array(each)), pa.array(((y - mean) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return entries.mapInArrow(out, SCHEMA)
