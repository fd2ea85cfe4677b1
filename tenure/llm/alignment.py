"""Operator 11, alignment of two tokenizations by interval coalescing, with corpus-wide counts of linked ids.

Every text is encoded by a byte-level tokenizer A (of space + text) and a piece tokenizer B (which adds the space).
Both cut the same bytes, so a token is an interval of byte offsets. The tokens of a run of documents are sorted
together by start (``lexsort``); ``maximum.accumulate`` over their ends gives how far the tokens so far reach, and a
group breaks where a start reaches that. Within groups the overlapping pairs are expanded; a pair of ids counts how
often it overlaps corpus-wide, and each document is then scored against those counts.

Neither tokenizer has a token across a single space between other characters (checked when they are loaded), so both
end there and so does a group. Texts are therefore taken unit by unit, a unit being what stands between such spaces; a
worker remembers the groups of the units it has met, up to ``MEMORY_BYTES``, and then forgets those met least.

One pass over the texts writes a slim row per document with its distinct id pairs; counts come from those rows by a
grouped sum with map-side aggregation. Up to ``BROADCAST_PAIRS`` distinct pairs the counts go to every worker,
more are joined by a shuffle; results are the same.

Defined cases: null and empty texts, and texts whose tokens' bytes are not space + text under either tokenizer, have
no tokens: all figures 0, ``groups_sha256`` empty, spans empty; they add nothing to the counts. Ids may be null or
repeat: a row is a document. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.shared import written

RUN_CHARS = 1 << 20
#: What a worker's memory of units may take; beyond it the units met least go until half of it is left.
MEMORY_BYTES = 96 << 20
#: Distinct id pairs up to which their counts (17 bytes each) are sent to every worker.
BROADCAST_PAIRS = 2_000_000
_TIMES_BITS = 31
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers: ids of text parts, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        back, vocab = _byte_of_char(), spec["model"]["vocab"]
        bytes_of = {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or [vocab[x + y] for x, y in merges] != list(range(256, 256 + len(merges))):
            raise ValueError(f"{path_a}: ids of a byte-level BPE must follow its merges")
        # ids follow the merges, so a rank encoder merges in the same order as the file says, several times faster
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytes_of, special_tokens={})
        self.bytes_a = [b""] * (max(bytes_of.values()) + 1)
        for token, i in bytes_of.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
                                else piece.replace("▁", " ").encode())
        if any(re.search(r"\S ", t.decode("utf-8", "replace")) for t in chain(self.bytes_a, self.bytes_b)):
            raise ValueError("a token spans a space between other characters")
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.n_b = len(self.bytes_b)
        if len(self.bytes_a) * self.n_b >= 1 << 32:
            raise ValueError("id pairs must fit 32 bits")
        top = max(len(self.bytes_a), self.n_b)
        self.printed = [str(i) + mark for i in range(top) for mark in (",", "|", ";")]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, ids of B, and how many each text has; none where either does not give back space + text."""
        spaced = [" " + t for t in texts]
        a, b = list(map(self.a.encode_ordinary, spaced)), self.b.encode(texts)
        if not (self._whole(a, spaced, self.bytes_a, self.len_a) and self._whole(b, spaced, self.bytes_b, self.len_b)):
            for i, text in enumerate(spaced):
                if not all(b"".join(map(table.__getitem__, ids)) == text.encode() for table, ids in ((self.bytes_a, a[i]), (self.bytes_b, b[i]))):
                    a[i], b[i] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        return (*(np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b))), n_a, n_b)

    @staticmethod
    def _whole(ids: list[list[int]], texts: list[str], table: list[bytes], size: np.ndarray) -> bool:
        """Whether every text's tokens are its bytes: all bytes in a row are the same, and so are their cuts."""
        flat = list(chain.from_iterable(ids))
        raw = [t.encode() for t in texts]
        if b"".join(map(table.__getitem__, flat)) != b"".join(raw):
            return False
        ends = np.concatenate([[0], np.cumsum(size[np.array(flat, np.int64)])])[np.cumsum([len(i) for i in ids])] if ids else np.zeros(0)
        return bool((ends == np.cumsum([len(r) for r in raw])).all())


class Run:
    """The tokens of texts, aligned together. ``a`` and ``b`` hold the ids text after text ("doc": a text's number)."""

    def __init__(self, pair: Pair, texts: list[str]):
        self.a, self.b, n_a, n_b = pair.encode(texts)
        self.n_a, self.n_b = n_a, n_b
        self.doc_a, self.doc_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        ends_a, ends_b = np.cumsum(pair.len_a[self.a]), np.cumsum(pair.len_b[self.b])
        starts_a, starts_b = ends_a - pair.len_a[self.a], ends_b - pair.len_b[self.b]
        # groups: all tokens by start (A first where equal); one begins where a start reaches the furthest end so far
        start, end = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order]) if len(order) else end
        begins = np.ones(len(order), bool)
        begins[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1
        self.group_a, self.group_b = group[:len(self.a)], group[len(self.a):]
        self.n_groups = np.bincount(np.concatenate([self.doc_a, self.doc_b])[order][begins], minlength=len(n_a))
        # overlaps: the B tokens that end after an A token's start and start before its end
        first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
        each = last - first
        self.link_a = np.repeat(np.arange(len(self.a)), each)
        self.link_b = np.arange(len(self.link_a)) + np.repeat(first - (np.cumsum(each) - each), each)
        self.starts_a, self.ends_a, self.starts_b, self.ends_b = starts_a, ends_a, starts_b, ends_b
        self.links = np.bincount(self.doc_a[self.link_a], minlength=len(n_a))

    def written(self, printed: list[str]) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        group = np.concatenate([self.group_a, self.group_b])
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.lexsort((side, group))  # stable: tokens of a side keep their places
        group, side = group[order], side[order]
        doc = np.concatenate([self.doc_a, self.doc_b])[order]
        mark = np.full(len(order), 2)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        token = np.concatenate([self.a, self.b])[order] * 3 + mark
        cuts = np.searchsorted(doc, np.arange(len(self.n_a) + 1)).tolist()
        words = list(map(printed.__getitem__, token.tolist()))
        return ["".join(words[lo:hi])[:-1] for lo, hi in zip(cuts[:-1], cuts[1:])]

    def spans(self) -> list[list[dict]]:
        """Each document's groups: byte offsets in space + text, A ids and B ids."""
        out: list[list[dict]] = [[] for _ in self.n_a]
        base = np.zeros(len(self.n_a), np.int64)
        heads = np.flatnonzero(np.r_[True, self.doc_a[1:] != self.doc_a[:-1]]) if len(self.doc_a) else np.empty(0, np.int64)
        base[self.doc_a[heads]] = self.starts_a[heads]
        groups = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        cut_a, cut_b = (np.searchsorted(g, np.arange(groups + 1)).tolist() for g in (self.group_a, self.group_b))
        for g in range(groups):
            a0, a1, b0, b1 = cut_a[g], cut_a[g + 1], cut_b[g], cut_b[g + 1]
            doc = int(self.doc_a[a0])
            out[doc].append({"start": int(self.starts_a[a0] - base[doc]), "end": int(self.ends_a[a1 - 1] - base[doc]),
                             "a": self.a[a0:a1].tolist(), "b": self.b[b0:b1].tolist()})
        return out


class Units:
    """The aligned units a worker remembers: figures, written groups and linked id pairs of each."""

    def __init__(self, pair: Pair, limit: int = MEMORY_BYTES):
        self.pair, self.limit = pair, limit
        self.slot: dict[str, int] = {}
        self.texts: list[str] = []
        #: Per unit: A tokens, B tokens, groups, links, and how often it was met.
        self.figures = np.zeros((0, 5), np.int64)
        self.codes, self.first = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.bytes = 0

    def learn(self, units: list[str]) -> None:
        run = Run(self.pair, units)
        self.slot.update(zip(units, range(len(self.texts), len(self.texts) + len(units))))
        self.texts += run.written(self.pair.printed)
        self.figures = np.concatenate([self.figures, np.column_stack([run.n_a, run.n_b, run.n_groups, run.links, np.zeros(len(units), np.int64)])])
        codes = run.a[run.link_a] * self.pair.n_b + run.b[run.link_b]
        self.codes, self.first = np.concatenate([self.codes, codes]), np.concatenate([self.first, self.first[-1] + np.cumsum(run.links)])
        self.bytes += sum(map(len, units)) + sum(map(len, self.texts[-len(units):])) + 8 * len(codes) + 300 * len(units)

    def forget(self) -> None:
        """Where the memory is full, keep what was met most, up to half of it; what was met once goes."""
        if self.bytes <= self.limit:
            return
        names = list(self.slot)
        size = np.fromiter((len(n) + len(t) for n, t in zip(names, self.texts)), np.int64, len(names)) + 8 * self.figures[:, 3] + 300
        order = np.argsort(-self.figures[:, 4], kind="stable")
        order = order[(np.cumsum(size[order]) <= self.limit // 2) & (self.figures[order, 4] > 1)]
        kept = np.sort(order)
        at = np.repeat(self.first[kept] - np.r_[0, np.cumsum(self.figures[kept, 3])][:-1], self.figures[kept, 3])
        self.codes = self.codes[at + np.arange(len(at))]
        self.figures = self.figures[kept]
        self.figures[:, 4] = 0
        self.first = np.r_[0, np.cumsum(self.figures[:, 3])]
        self.texts = [self.texts[i] for i in kept.tolist()]
        self.slot = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.bytes = int(size[kept].sum())

    def documents(self, texts: list[str | None]) -> dict[str, np.ndarray | list | pa.Array]:
        """The figures, digests and distinct pairs (``code << 31 | times``, ascending) of a run of documents."""
        self.forget()
        units, n_units = [], []
        for text in texts:
            mine = _SPACE.split(text) if text else []
            units += mine
            n_units.append(len(mine))
        if new := [u for u in dict.fromkeys(units) if u not in self.slot]:
            self.learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, units), np.int64, len(units))
        self.figures[:, 4] += np.bincount(slots, minlength=len(self.figures))
        doc = np.repeat(np.arange(len(texts)), n_units)
        lost = np.bincount(doc[self.figures[slots, 0] == 0], minlength=len(texts)) > 0  # a unit did not give back its text
        slots, doc = slots[~lost[doc]], doc[~lost[doc]]
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        each = self.figures[slots, 3]
        at = np.repeat(self.first[slots] - (np.cumsum(each) - each), each)
        distinct, times = np.unique((np.repeat(doc, each) << 32) | self.codes[at + np.arange(len(at))], return_counts=True)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.figures[slots, :4], 0)])
        sums = sums[cuts[1:]] - sums[cuts[:-1]]
        words = list(map(self.texts.__getitem__, slots.tolist()))
        digests = [hashlib.sha256(";".join(words[lo:hi]).encode()).hexdigest() if hi > lo else "" for lo, hi in zip(cuts[:-1], cuts[1:])]
        pairs = pa.ListArray.from_arrays(pa.array(np.searchsorted(distinct >> 32, np.arange(len(texts) + 1)), pa.int32()),
                                         pa.array(((distinct & 0xFFFFFFFF) << _TIMES_BITS) | times, pa.int64()))
        return dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums.T)) | {"groups_sha256": digests, "pairs": pairs}


_UNITS: dict[tuple[str, str], Units] = {}
_SPAN = "array<struct<start: long, end: long, a: array<int>, b: array<int>>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
SLIM = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def tokenized(docs: DataFrame, paths: tuple[str, str] | None = None, with_spans: bool = False) -> DataFrame:
    """A row per document: its figures, ``pairs`` (distinct id pairs with their times) and, on demand, ``spans``."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = paths or default_tokenizers()
        units = _UNITS.get(where) or _UNITS.setdefault(where, Units(Pair(*where)))
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            lo, size = 0, 0
            run: list[str | None] = []
            for i in range(batch.num_rows):
                run.append(texts[i].as_py())
                size += len(run[-1] or "")
                if size >= RUN_CHARS or i + 1 == batch.num_rows:
                    yield rows(units, ids.slice(lo, i + 1 - lo), run)
                    lo, size, run = i + 1, 0, []

    def rows(units: Units, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        cols = {"doc_id": ids} | units.documents(texts)
        if with_spans:
            cols["spans"] = pa.array(Run(units.pair, [t or "" for t in texts]).spans(), _SPAN_TYPE)
        return pa.RecordBatch.from_pydict(cols)

    schema = SLIM + ", pairs array<long>" + f", spans {_SPAN}" * with_spans
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, schema)


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """code, count and best (no other pair of its B id counts more) of every id pair linked anywhere."""
    pair = F.explode("pairs").alias("p")
    counts = (rows.select(pair).groupBy(F.shiftright("p", _TIMES_BITS).alias("code"))
              .agg(F.sum(F.col("p").bitwiseAND((1 << _TIMES_BITS) - 1)).alias("count")))
    counts = written(counts.withColumn("b", F.col("code") % n_b), "pair-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(best, "b").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, with_spans: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (, spans) of every document."""
    import sentencepiece
    n_b = sentencepiece.SentencePieceProcessor(model_file=(paths or default_tokenizers())[1]).get_piece_size()
    rows = written(tokenized(docs, paths, with_spans), "aligned")
    counts = written(pair_counts(rows, n_b), "pair-best")
    keep = [c for c in rows.columns if c != "pairs"]
    if counts.count() > broadcast_pairs:
        return _joined(rows, counts, keep)
    table = counts.orderBy("code").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast([table[c].to_numpy() for c in ("code", "count", "best")])
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, count, best = sent.value
        for batch in batches:
            pairs = batch.column("pairs")
            flat, cuts = pairs.flatten().to_numpy(), pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            at, times = np.searchsorted(codes, flat >> _TIMES_BITS), flat & ((1 << _TIMES_BITS) - 1)
            upto = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * count[at])] if len(codes) else [np.zeros(1, np.int64)] * 2
            sums = [pa.array(x[cuts[1:]] - x[cuts[:-1]], pa.int64()) for x in upto]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *sums], [*keep, "n_best", "count_sum"])

    got = rows.mapInArrow(look_up, ", ".join(f"{c} {fields[c]}" for c in keep) + ", n_best long, count_sum long")
    return got.select(*keep[:5], "n_best", "count_sum", *keep[5:])


def _joined(rows: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """The same by a shuffle, for more pairs than a worker should hold; skewed codes are split by the join."""
    # the row number is read from the written rows, so it is the same in both branches only once it is written as well
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned-rows")
    links = rows.select("_row", F.explode("pairs").alias("p")).select(
        "_row", F.shiftright("p", _TIMES_BITS).alias("code"), F.col("p").bitwiseAND((1 << _TIMES_BITS) - 1).alias("times"))
    sums = links.join(counts, "code").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.select("_row", *keep).join(sums, "_row", "left").select(*keep[:5], *zero, *keep[5:])
