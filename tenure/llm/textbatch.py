"""Whole-batch text work on Arrow string columns with numpy.

A batch is cut into runs of rows of about a megabyte, so memory does not follow the Arrow batch size; one
text longer than that is a run of its own and costs a few bytes per byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
RUN_BYTES = 1 << 20
#: Byte classes: 0 is white space; a word is a run of one class above 0.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
#: Letters, digits and non-ASCII apart from runs of other characters.
WORDS_AND_MARKS = WORDS.copy()
WORDS_AND_MARKS[[b for b in range(128) if WORDS[b] and not chr(b).isalnum()]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix style), wrapping."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = _powers(_BASE, RUN_BYTES + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), RUN_BYTES + 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span ``data[start:end]``; spans are ascending and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + RUN_BYTES, "right"))
        if j <= i:  # one span longer than a run: its pieces' hashes, chained
            h = U(0)
            for p in range(lo, int(ends[i]), RUN_BYTES):
                piece = _BYTE[data[p:min(p + RUN_BYTES, int(ends[i]))]]
                h = mix(np.array([h], np.uint64) + (piece * _POW[:len(piece)]).sum(dtype=np.uint64))[0]
            out[i] = h
            i += 1
            continue
        hi = int(ends[j - 1])
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * _POW[:hi - lo], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((run[e] - run[s]) * _INV[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Run:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, words and word hashes."""

    def __init__(self, lo: int, data: np.ndarray, offsets: np.ndarray, lower: bool, classes: np.ndarray):
        self.lo, self.hi = lo, lo + len(offsets) - 1
        self.data, self.offsets = (LOWER[data] if lower else data), offsets
        kind = classes[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        cut[offsets] = True
        self.starts = np.flatnonzero(cut[:-1] & (kind > 0))
        self.ends = np.flatnonzero(cut[1:] & (kind > 0)) + 1
        self.first = np.searchsorted(self.starts, offsets)  # row r has words first[r] to first[r + 1]

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(column: pa.Array | pa.ChunkedArray, lower: bool = False, classes: np.ndarray = WORDS,
         run_bytes: int = RUN_BYTES) -> Iterator[Run]:
    """The rows of a string column (null: empty text) as runs of about ``run_bytes``, at least a row each."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return
    _, offs, buf = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + run_bytes, "right")) - 1)
        yield Run(lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], lower, classes)
        lo = hi


_LANE = mix(np.arange(1, 65, dtype=np.uint64)) | U(1)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (across rows too; callers cut at rows)."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    acc = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        acc += hashes[k:len(hashes) - n + 1 + k] * _LANE[k % 64] + U(k)
    return mix(acc)


def shingle_sets(run: Run, n: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct n-word shingles; with fewer words the whole sequence as one; no words: none."""
    words = run.hashes()
    grams = windows(words, n)
    for a, b in zip(run.first[:-1].tolist(), run.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            yield windows(words[a:b], b - a) ^ U(b - a)
        else:
            yield np.empty(0, np.uint64)
