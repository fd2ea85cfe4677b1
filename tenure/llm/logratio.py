"""Operator 6, quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Word 1- and 2-grams are hashed into ``buckets``. Two multinomials are counted over all documents: the trusted
target (documents that ``labels`` mark as quality 1) and the raw corpus (every document). A document's score is
the mean over its n-grams of ``log((t + k) / (r * T / R + k))`` with the bucket's counts t and r, the totals T
and R and the pseudo-count k, so rare n-grams say little. ``kept`` is ``score >= threshold`` for every document
that the base rules pass: one fixed threshold, no sampling.

Defined cases: null and empty texts have no words, fail the base rules and score 0; repeated rows are counted
and judged each on its own; a document is trusted if any of its labels is 1 (null ids match no label); without
trusted documents all scores are 0; with an empty table the result is empty. Columns that are named like an
output are replaced by it, others are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.textbatch import Run, runs, windows

BUCKETS = 1 << 16
PSEUDO = 5.0
#: Trusted ids up to this many (about 80 bytes each in a hash table) are broadcast, so that no text is shuffled.
BROADCAST_IDS = 1_000_000
THRESHOLD = -0.1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _grams(run: Run, words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and of every pair of words inside a row."""
    row = run.row_of_word()
    pairs = windows(words, 2)
    inside = row[1:] == row[:-1] if len(row) else np.empty(0, bool)
    grams = np.concatenate([words, pairs[inside]])
    return np.concatenate([row, row[1:][inside]]), (grams % np.uint64(buckets)).astype(np.int64)


def ngram_counts(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, target, raw) counts over all documents; ``trusted_ids`` has distinct doc_id."""
    ids = trusted_ids.select("doc_id", F.lit(True).alias("trusted")).persist()
    if ids.count() <= BROADCAST_IDS:  # else documents and ids meet in a shuffle
        ids = F.broadcast(ids)
    flagged = docs.select("doc_id", "text").join(ids, "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            trusted = np.array(batch.column("trusted").fill_null(False).to_pylist(), bool)
            for run in runs(batch.column("text")):
                row, bucket = _grams(run, run.hashes(), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[trusted[run.lo:run.hi][row]], minlength=buckets)
        seen = np.flatnonzero(raw)
        for lo in range(0, len(seen), 10_000):
            s = seen[lo:lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(target[s]), pa.array(raw[s])], ["bucket", "target", "raw"])

    rows = flagged.select("text", "trusted").mapInArrow(count, "bucket long, target long, raw long")
    return rows.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, pseudo: float = PSEUDO) -> np.ndarray:
    """The ratio of each bucket; at most ``buckets`` rows reach the driver."""
    got = counts.toPandas()
    target, raw = np.zeros(buckets), np.zeros(buckets)
    target[got.bucket], raw[got.bucket] = got.target, got.raw
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + pseudo) / (raw * (target.sum() / raw.sum()) + pseudo))


def repeated_words(grams: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more; ``grams`` are one text's windows."""
    if not len(grams):
        return 0
    _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
    twice = times[back] > 1
    covered = np.zeros(len(grams) + 2, bool)
    for k in range(3):
        covered[k:k + len(grams)] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            n += line in seen
            seen.add(line)
    return n


OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(ratios: np.ndarray, names: list[str]) -> Callable:
    buckets = len(ratios)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for run in runs(batch.column("text")):
                n = run.hi - run.lo
                words = run.hashes()
                grams = windows(words, 3)
                points = np.concatenate([[0], np.cumsum((run.data & 0xC0) != 0x80)])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[run.data])])
                chars = np.concatenate([[0], np.cumsum(points[run.ends] - points[run.starts])])
                row, bucket = _grams(run, words, buckets)
                total = np.bincount(row, ratios[bucket], n) / np.maximum(np.bincount(row, minlength=n), 1)
                first = run.first
                repeats = [repeated_words(grams[a:max(a, b - 2)]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                raw, offs = run.data.tobytes(), run.offsets.tolist()
                lines = [duplicate_lines(raw[a:b]) for a, b in zip(offs, offs[1:])]
                for part, values in zip(parts, (np.diff(first), chars[first[1:]] - chars[first[:-1]], symbols[run.offsets[1:]] - symbols[run.offsets[:-1]],
                                                np.array(lines), np.array(repeats), total)):
                    part.append(values)
            if not batch.num_rows:
                continue
            cols = [np.concatenate(p) for p in parts]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c.astype(np.int64)) for c in cols[:5]] + [pa.array(cols[5].astype(np.float64))],
                                             [*names, *OUTPUTS, "score"])
    return judge


def trusted_documents(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, pseudo: float = PSEUDO) -> DataFrame:
    """Every row of ``docs`` with the base counts, score, base_failed and kept."""
    ratios = log_ratios(ngram_counts(docs, trusted_documents(labels), buckets), buckets, pseudo)
    judged = ("base_failed", "kept", "score", *OUTPUTS)
    rows = docs.drop(*(c for c in docs.columns if c in judged))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} long" for c in OUTPUTS), "score double"])
    out = rows.mapInArrow(_judge(ratios, rows.columns), schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
