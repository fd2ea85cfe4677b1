"""Operator 8, nearest neighbours by hash-prefix forests.

Candidates are dealt into blocks by a hash of their id. A block's forest has ``trees`` trees, each a sorted array
of 64-bit hash strings (signs of projections on random directions around the block's mean). For a query every
tree is descended to its longest matching prefix; then all trees ascend together, bit by bit, and every row that
shares the current prefix in any tree is measured exactly. Ascent ends when a row nearer than the k-th best so
far would have been missed by all trees with probability at most ``miss``: its angle at the block's mean has a
known bound, and (1 - (1 - angle / pi) ** bits) ** trees is what all trees miss; at the root the block has been
searched whole. So there is no cap on candidates, and recall does not depend on the size of the data. The k best
of each block are merged.

Queries are a stated set. A task holds one block, builds its forest once and streams a part of the queries through it,
some at a time; candidates of a step are measured together.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components, and rows with a null id,
take no part; candidates of another length than the query's are never its neighbours; the query's own id is never
its neighbour; rows that repeat an id are candidates each; a query id that repeats searches with its smallest
vector; fewer than k candidates give all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 16
MISS = 0.02
BLOCK_ROWS = 8192
#: A block is searched by this many queries per task, which builds its forest once.
QUERY_ROWS = 65_536
SEED = 8
#: Pairs of a block and a part of the queries beyond this share tasks.
MOST_TASKS = 100_000
#: Queries that ascend together: bounds a step's arrays to this many times a block's rows.
_TOGETHER = 64
#: Differences of a step are taken for so many numbers at once.
_NUMBERS = 1 << 21


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of 64-bit strings."""
    x = a ^ b
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range (its place) each position belongs to, and the positions, of many ranges."""
    lengths = np.maximum(stops - starts, 0)
    which = np.repeat(np.arange(len(lengths)), lengths)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[which]


class Forest:
    def __init__(self, rows: np.ndarray, trees: int, seed: int):
        self.rows = rows
        self.squares = (rows * rows).sum(1)
        self.middle = rows.mean(0)
        away = rows - self.middle
        norms = np.sqrt((away * away).sum(1))
        self.near, self.far = float(norms.min()), float(norms.max())
        self.directions = np.random.default_rng(seed).standard_normal((trees, rows.shape[1], 64))
        codes = [self._codes(away, t) for t in range(trees)]
        self.order = [np.argsort(c, kind="stable") for c in codes]
        self.sorted = [c[o] for c, o in zip(codes, self.order)]

    def _codes(self, away: np.ndarray, tree: int) -> np.ndarray:
        bits = (away @ self.directions[tree]) > 0
        return np.packbits(bits, axis=1, bitorder="big").view(">u8").ravel().astype(np.uint64)

    def _missed(self, norms: np.ndarray, distances: np.ndarray, bits: int) -> np.ndarray:
        """Per query, the most likely it can be that a row within its distance shares ``bits`` bits in no tree."""
        if bits == 0:
            return np.zeros(len(norms))
        with np.errstate(all="ignore"):
            gap = norms * norms - distances * distances
            norm = np.where(gap > 0, np.clip(np.sqrt(np.maximum(gap, 0.0)), self.near, self.far), self.near)
            angle = np.arccos(np.clip((gap + norm * norm) / (2 * norms * norm), -1.0, 1.0))
            missed = (1.0 - (1.0 - angle / np.pi) ** bits) ** len(self.sorted)
        return np.where((norms > 0) & np.isfinite(distances) & (norm > 0), missed, 1.0)

    def _measure(self, queries: np.ndarray, fresh: np.ndarray, q: np.ndarray, r: np.ndarray, products: list) -> np.ndarray:
        """Squared distances of the fresh pairs from dot products: of all pairs where most are fresh, else of those."""
        if len(q) * 8 > fresh.size:
            if not products:
                products.append(queries @ self.rows.T)
            dots = products[0][q, r]
        else:
            step = max(1, _NUMBERS // self.rows.shape[1])
            dots = np.concatenate([np.einsum("ij,ij->i", queries[q[i:i + step]], self.rows[r[i:i + step]]) for i in range(0, len(q), step)])
        return (queries * queries).sum(1)[q] + self.squares[r] - 2.0 * dots

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the k nearest found of each query, ties at the k-th included.

        ``own`` marks, per query, rows that are not candidates. The queries ascend together, each from its longest
        match to where its own bound holds. Squared distances from dot products choose who can be among the nearest,
        with room for their rounding; the distances returned are taken from the differences.
        """
        m, n = own.shape
        away = queries - self.middle
        norms = np.sqrt((away * away).sum(1))
        codes = [self._codes(away, t) for t in range(len(self.sorted))]
        lows = [np.searchsorted(have, code) for code, have in zip(codes, self.sorted)]
        highs = [at.copy() for at in lows]
        start = np.max([_shared_bits(have[np.clip(at + i, 0, n - 1)], code)
                        for code, have, at in zip(codes, self.sorted, lows) for i in (-1, 0)], axis=0)
        room = 8.0 * queries.shape[1] * np.finfo(float).eps * ((queries * queries).sum(1) + self.squares.max())
        seen, best = own.copy(), np.full((m, k), np.inf)
        products: list[np.ndarray] = []
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        going = np.ones(m, bool)
        for bits in range(int(start.max()), -1, -1):
            active = np.flatnonzero(going & (start >= bits))
            if not len(active):
                continue
            rest = np.uint64((1 << (64 - bits)) - 1)
            fresh = np.zeros((m, n), bool)
            for t, (code, have) in enumerate(zip(codes, self.sorted)):
                lo = np.searchsorted(have, code[active] & ~rest)
                hi = np.searchsorted(have, code[active] | rest, "right")
                for starts, stops in ((lo, lows[t][active]), (highs[t][active], hi)):
                    which, at = _ranges(starts, stops)
                    fresh[active[which], self.order[t][at]] = True
                lows[t][active], highs[t][active] = lo, hi
            fresh &= ~seen
            seen |= fresh
            q, r = np.nonzero(fresh)
            if len(q):
                d = self._measure(queries, fresh, q, r, products)
                hit = d <= (best[:, -1] + 2.0 * room)[q]
                q, r, d = q[hit], r[hit], d[hit]
                kept.append((q, r, d))
                by = np.lexsort((d, q))
                first = np.searchsorted(q[by], np.arange(m))
                place = np.arange(len(by)) - first[q[by]]
                new = np.full((m, k), np.inf)
                by, place = by[place < k], place[place < k]
                new[q[by], place] = d[by]
                best = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, :k]
            kth = np.sqrt(np.maximum(best[active, -1], 0.0))
            going[active[self._missed(norms[active], kth, bits) <= miss]] = False
        q, r, d = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        near = d <= (best[:, -1] + 2.0 * room)[q]
        q, r = q[near], r[near]
        apart = self.rows[r] - queries[q]
        return q, r, np.sqrt((apart * apart).sum(1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", trees: int = TREES,
            miss: float = MISS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest rows of ``vectors``."""
    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return (df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
                .where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")))

    rows = usable(vectors)
    asked = usable(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks, parts = max(1, -(-rows.count() // block_rows)), max(1, -(-asked.count() // query_rows))
    some = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = (rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("part", F.explode(some(parts)))
            .withColumn("asks", F.lit(False)))
    right = (asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(some(blocks).cast("array<long>")))
             .withColumn("asks", F.lit(True)))
    columns = [(F.col("block") * parts + F.col("part")).alias("pair"), "dim", "asks", "id", "v"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a pair's candidates of one length, then the queries that search them, batch by batch."""
        at, have, ids, forest = None, [], None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "dim", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)] if len(key) else []
            for lo, hi in zip(cuts, cuts[1:]):
                run, (pair, dim, asks) = batch.slice(lo, hi - lo), key[lo]
                if (pair, dim) != at:
                    at, have, forest = (pair, dim), [], None
                run_ids = run.column("id").to_numpy()
                run_rows = run.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if not asks:
                    have.append((run_ids, run_rows))
                    continue
                if forest is None and have:
                    ids = np.concatenate([x[0] for x in have])
                    forest, have = Forest(np.concatenate([x[1] for x in have]), trees, seed), []
                for i in range(0, len(run_ids) if forest else 0, _TOGETHER):
                    some_ids = run_ids[i:i + _TOGETHER]
                    q, r, d = forest.search(run_rows[i:i + _TOGETHER], some_ids[:, None] == ids[None], k, miss)
                    by = np.lexsort((ids[r], d, q))
                    q, r, d = q[by], r[by], d[by]
                    top = np.arange(len(q)) - np.searchsorted(q, q) < k
                    yield pa.RecordBatch.from_arrays([pa.array(some_ids[q[top]]), pa.array(ids[r[top]]), pa.array(d[top])],
                                                     names=["query_id", "vec_id", "score"])

    dealt = left.select(*columns).unionByName(right.select(*columns)).repartitionById(min(blocks * parts, MOST_TASKS), F.pmod("pair", F.lit(MOST_TASKS)).cast("int"))
    found = dealt.sortWithinPartitions("pair", "dim", "asks", "id").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
