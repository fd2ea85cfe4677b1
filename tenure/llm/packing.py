"""Operator 1, packing by non-negative least squares over a length histogram.

A document's ids are cut into whole windows and one remainder; pieces are binned by length (rounded up to
``BIN`` tokens). Shallow combinations of bins that fill a window exactly are enumerated: up to three pieces of
any bins, and up to two bins repeated. Non-negative least squares finds how often to use each so the used
pieces match the histogram; the counts are rounded down and bound to pieces by each piece's place in its bin.
Pieces left over are packed greedily (best fit, longest first, exact lengths) in chunks dealt by hash.

Only the histogram (a row per bin) and the table of chosen combinations (a few rows per bin) pass the driver.

Defined cases: a null text is empty and its document is the end id alone; empty tables give no pieces; repeated
rows are packed each on its own; documents of any length are cut, none is dropped; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.shared import numbered, written
from tenure.llm.textbatch import WORDS_AND_MARKS, Run, runs, span_hashes

WINDOW = 4096
BIN = 16
END_ID = 2
CHUNK_PIECES = 20_000
#: What a worker's memory of units may take, and what each takes beside its bytes and ids.
MEMORY_BYTES = 96 << 20
UNIT_BYTES = 160
#: Words of ASCII letters up to this long are encoded in runs.
LETTERS = 200


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _units(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first unit per row of what can be tokenized apart.

    A unit is a word, or a part of one: runs of ASCII letters and digits stand apart from runs of ASCII marks,
    but a word with an apostrophe (it joins what follows), with the start of a special token or with a mark beside
    a non-ASCII character (which may be a mark as well, or combine) stays whole.
    """
    data = run.data
    kind = WORDS_AND_MARKS[data]
    change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    word = np.searchsorted(run.starts, change, "right") - 1
    change, word = change[change < run.ends[word]], word[change < run.ends[word]]  # rows may meet without a space
    change, word = change[change > run.starts[word]], word[change > run.starts[word]]
    whole = np.zeros(len(run.starts), bool)
    whole[word[(data[change] > 127) | (data[change - 1] > 127)]] = True
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|" may begin a special token
    for at in (np.flatnonzero(data == 39), special):
        whole[np.searchsorted(run.starts, at, "right") - 1] = True
    change = change[~whole[word]]
    starts, ends = np.sort(np.concatenate([run.starts, change])), np.sort(np.concatenate([run.ends, change]))
    return starts, ends, np.searchsorted(starts, run.offsets)


class Letters:
    """The ids of words of ASCII letters, many in one call, as the tokenizer's merges give them.

    A word's last letter is another symbol than the same letter inside (it carries the word end); written as a
    capital, it lets a rank encoder merge whole runs of words, and tells where each ends. ``tests`` hold it against
    the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        symbol = lambda t: (t[:-len(end) - 1] + t[-len(end) - 1].upper() if t.endswith(end) else t).encode()
        plain = lambda t: re.fullmatch("[a-z]+", t.removesuffix(end)) is not None
        tokens = [c + e for e in ("", end) for c in "abcdefghijklmnopqrstuvwxyz"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        tokens += [a + b for a, b in merges if plain(a + b)]
        self.encoding = tiktoken.Encoding("letters", pat_str="[a-z]*[A-Z]", mergeable_ranks={symbol(t): i for i, t in enumerate(tokens)}, special_tokens={})
        self.ids = np.array([vocab[t] for t in tokens], np.uint32)
        self.ends = np.array([t.endswith(end) for t in tokens])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has."""
        text = b"".join([w[:-1].lower() + w[-1:].upper() for w in words]).decode()
        got = np.array(self.encoding.encode_ordinary(text), np.int64)
        return self.ids[got], np.diff(np.flatnonzero(self.ends[got]), prepend=-1)


class WordIds:
    """Token ids of texts, unit by unit; units are remembered, by their bytes, up to ``MEMORY_BYTES``.

    Right for a tokenizer that drops white space and never joins letters or digits with marks, except after an
    apostrophe; ``__init__`` tries that on a probe text and refuses others.
    """

    def __init__(self, path: str, limit: int = MEMORY_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|")}
        self.mark = min(special, default=None)
        self.between = f" {special[self.mark]} " if special else None
        self.letters = Letters(path)
        self.slot: dict[bytes, int] = {}
        self.at, self.size, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.flat, self.end, self.bytes = np.zeros(1 << 18, np.uint32), 0, 0
        probe = "It's 3,5 (or 12%) of\tthe _odd_ \u00fcnits... isn't it?\n\nA-b c&d 'q' x2y"
        if np.concatenate([*self.documents(pa.array([probe]))]).tolist()[:-1] != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} does not cut texts at white space and between letters and marks")

    def _ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units in a row, and how many each has."""
        simple = [u.isalpha() and len(u) <= LETTERS for u in units]  # of bytes: ASCII letters only
        parts = (self.letters.encode(list(compress(units, simple))), self._others([u for u, easy in zip(units, simple) if not easy]))
        if all(simple):
            return parts[0]
        of = np.where(simple, 0, 1)
        sizes, starts = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        for k, (ids, size) in enumerate(parts):
            sizes[of == k] = size
            starts[of == k] = np.cumsum(size) - size + (len(parts[0][0]) if k else 0)
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.concatenate([ids for ids, _ in parts])[at], sizes

    def _others(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the tokenizer: a thousand units are encoded at once, a special token between them."""
        words = [u.decode() for u in units]
        alone = [w for w in words if "<|" in w or self.mark is None]
        joined = [w for w in words if not ("<|" in w or self.mark is None)]
        parts = [joined[i:i + 1000] for i in range(0, len(joined), 1000)]
        found: dict[str, np.ndarray] = {}
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([self.between.join(p) for p in parts], add_special_tokens=False) if parts else ()):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            for w, lo, hi in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                found[w] = ids[lo:hi]
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False) if alone else ()):
            found[w] = np.array(e.ids, np.uint32)
        got = [found[w] for w in words]
        return np.concatenate([np.empty(0, np.uint32), *got]), np.fromiter(map(len, got), np.int64, len(got))

    def _learn(self, units: list[bytes]) -> None:
        ids, sizes = self._ids(units)
        n = len(self.slot)
        self.slot.update(zip(units, range(n, n + len(units))))
        if len(self.slot) > len(self.at):
            more = np.zeros(max(len(self.at), len(units)), np.int64)
            self.at, self.size, self.met = (np.concatenate([a, more]) for a in (self.at, self.size, self.met))
        if self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.at[n:n + len(units)] = self.end + np.cumsum(sizes) - sizes
        self.size[n:n + len(units)] = sizes
        self.met[n:n + len(units)] = 0
        self.flat[self.end:self.end + len(ids)] = ids
        self.end += len(ids)
        self.bytes += sum(map(len, units)) + 4 * len(ids) + UNIT_BYTES * len(units)

    def _forget(self) -> None:
        """Where the memory is full, keep the units met most, up to half of it; those met once go."""
        if self.bytes <= self.limit:
            return
        units, n = list(self.slot), len(self.slot)
        size = np.fromiter(map(len, units), np.int64, n) + 4 * self.size[:n] + UNIT_BYTES
        order = np.argsort(-self.met[:n], kind="stable")
        kept = np.sort(order[(np.cumsum(size[order]) <= self.limit // 2) & (self.met[order] > 1)])
        ids = np.concatenate([np.empty(0, np.uint32), *(self.flat[self.at[i]:self.at[i] + self.size[i]] for i in kept.tolist())])
        k = len(kept)
        self.size[:k] = self.size[kept]
        self.at[:k] = np.cumsum(self.size[:k]) - self.size[:k]
        self.met[:] = 0
        self.flat[:len(ids)], self.end = ids, len(ids)
        self.slot = {units[i]: j for j, i in enumerate(kept.tolist())}
        self.bytes = int(size[kept].sum())

    def documents(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        for run in runs(column):
            self._forget()
            starts, ends, first = _units(run)
            units, back = _distinct(run.data, starts, ends)
            if new := [u for u in units if u not in self.slot]:
                self._learn(new)
            distinct = np.fromiter(map(self.slot.__getitem__, units), np.int64, len(units))
            self.met[distinct] += np.bincount(back, minlength=len(units))
            slots = distinct[back]
            sizes = self.size[slots]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.flat[np.repeat(self.at[slots] - upto[:-1], sizes) + np.arange(upto[-1])]
            cuts = upto[first]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield np.append(ids[a:b], np.uint32(END_ID))


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct units, and for each unit which of them it is. Found by hash, then compared byte by byte."""
    _, where, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    raw, size, like = data.tobytes(), ends - starts, where[back]
    if (size == size[like]).all():
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        if (data[inside + np.repeat(starts, size)] == data[inside + np.repeat(starts[like], size)]).all():
            return [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())], back
    found: dict[bytes, int] = {}  # two units share a hash: number them by their bytes
    back = np.array([found.setdefault(raw[a:b], len(found)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    return list(found), back


_TOKENIZERS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path or default_tokenizer()
        coder = _TOKENIZERS.setdefault(path, None) or _TOKENIZERS.update({path: WordIds(path)}) or _TOKENIZERS[path]
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.documents(batch.column("text"))):
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    for out, v in zip(rows, (doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids), piece.astype(np.int32))):
                        out.append(v) if out is not rows[5] or with_ids else None
            cols = [pa.array(r, pa.int64()) for r in rows[:5]] + ([pa.array(rows[5], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)
    return docs.mapInArrow(cut, schema)


def combinations(bins: int) -> list[tuple[tuple[int, int], ...]]:
    """Combinations ((bin, times), ...) that fill ``bins`` units: any three pieces at most, or two bins repeated."""
    found = {((a, 1), (b, 1), (c, 1)) for a in range(1, bins + 1) for b in range(a + 1, bins + 1) if (c := bins - a - b) > b}
    for a in range(1, bins + 1):
        for times in range(1, bins // a + 1):
            rest = bins - a * times
            if not rest:
                found.add(((a, times),))
            found |= {((a, times), (b, rest // b)) for b in range(a + 1, rest + 1) if rest % b == 0}
    return sorted(found)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-9 * scale:
            break
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            part = a[:, at]
            s = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(at)), part.T @ b)
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12 * scale) | (low & (x[at] <= 1e-9 * scale))]
            if not len(gone):
                gone = at[low][:1]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], bins: int) -> tuple[list[tuple[int, int, int, int, int, int]], dict[int, int], int]:
    """Segments (bin, first place, end place, first sequence, times, first slot), places used per bin, sequences used."""
    combos = [c for c in combinations(bins) if all(histogram.get(b, 0) >= t for b, t in c)]
    if not combos:
        return [], {}, 0
    a = np.zeros((bins, len(combos)))
    for j, c in enumerate(combos):
        for b, t in c:
            a[b - 1, j] = t
    x = nnls(a, np.array([histogram.get(b, 0) for b in range(1, bins + 1)], float))
    used: dict[int, int] = {}
    segments, sequences = [], 0
    for j in np.argsort(-x, kind="stable").tolist():
        times = min([int(x[j] + 1e-6), *((histogram[b] - used.get(b, 0)) // t for b, t in combos[j])])
        if times <= 0:
            continue
        slot = 0
        for b, t in combos[j]:
            segments.append((b, used.get(b, 0), used.get(b, 0) + times * t, sequences, t, slot))
            used[b] = used.get(b, 0) + times * t
            slot += t
        sequences += times
    return segments, used, sequences


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece, longest first into the fullest open sequence that has room."""
    open_by_room: list[list[int]] = [[] for _ in range(window + 1)]
    rooms = np.zeros(window + 1, bool)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    n = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        room = need + int(np.argmax(rooms[need:]))
        if rooms[room]:
            s = open_by_room[room].pop()
            rooms[room] = bool(open_by_room[room])
        else:
            s, room, n = n, window, n + 1
        out[i] = (s, window - room)
        left = room - need
        open_by_room[left].append(s)
        rooms[left] = left > 0
    return out


def pack(rows: DataFrame, window: int = WINDOW, bin_width: int = BIN, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """Add sequence_id and offset to the pieces (doc_id, start, length, ids_crc32, doc_tokens, ...)."""
    spark = rows.sparkSession
    bins = -(-window // bin_width)
    key = F.xxhash64("doc_id", "start", "ids_crc32", "length")
    rows = rows.withColumns({"_bin": F.ceil(F.col("length") / bin_width).cast("int"), "_h": F.shiftrightunsigned(key, 32)})
    histogram = {r["_bin"]: r["count"] for r in rows.groupBy("_bin").count().collect()}
    segments, used, sequences = plan(histogram, bins)
    placed = numbered(rows, ["_bin"], "_h", ["doc_id", "start"], "_place")
    table = spark.createDataFrame(segments, "bin int, lo long, hi long, first long, times long, slot long")
    inside = (F.col("_bin") == F.col("bin")) & (F.col("_place") >= F.col("lo")) & (F.col("_place") < F.col("hi"))
    dealt = placed.join(F.broadcast(table), inside, "left")  # the table has a few rows per combination used
    keep = [c for c in rows.columns if c not in ("_bin", "_h")]
    at = F.col("_place") - F.col("lo")
    by_slot = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    combined = (dealt.where("bin IS NOT NULL")
                .select(*keep, (F.col("first") + F.floor(at / F.col("times"))).cast("long").alias("sequence_id"), (F.col("slot") + at % F.col("times")).alias("_slot"))
                .withColumn("offset", F.coalesce(F.sum("length").over(by_slot), F.lit(0)).cast("long")).drop("_slot"))
    rest = sum(histogram.values()) - sum(used.values())
    chunks = max(1, -(-rest // chunk_pieces))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", sequence_id long, offset long"

    def greedy(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_h", "doc_id", "start"], kind="stable").reset_index(drop=True)
        got = best_fit(pdf["length"].tolist(), window)
        ids = [sequences + int(key[0]) * (1 << 32) + s for s, _ in got]
        return pdf[keep].assign(sequence_id=np.array(ids, np.int64), offset=np.array([o for _, o in got], np.int64))

    left = (dealt.where("bin IS NULL").select(*keep, "_h", F.pmod(F.xxhash64("_h", "doc_id"), F.lit(chunks)).alias("_chunk"))
            .groupBy("_chunk").applyInPandas(greedy, schema))
    return combined.select(*keep, "sequence_id", "offset").unionByName(left)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """All documents as packed pieces: doc_id, start, length, ids_crc32, doc_tokens (, ids), sequence_id, offset."""
    return pack(written(pieces(docs, tokenizer_path, window, with_ids), "pieces"), window)
