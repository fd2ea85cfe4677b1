"""Operator 7, quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

Tokens are runs of letters, digits and non-ASCII, and runs of other characters, case kept. Features are hashed
token 1- and 2-grams; a pair is hashed by the difference of its tokens' hashes, so every token that repeats
itself falls on the same feature. Values are log counts scaled to unit length. Training is FTRL-proximal over
a bounded sample (``max_rows`` expected, chosen by a hash of the id) of the labelled rows that are not held out:
one pass after another in hash order, in one task. Every row is then scored as a sparse dot product.

Defined cases: null and empty texts have no features and get the intercept's score; null labels are not learned
from; a null id is not held out and is not learned from; a document with several labels is learned once per
label row; repeated rows are scored each; without labels all weights are 0 and every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.shared import fold_of, hex_int, seeded_hex
from tenure.llm.textbatch import WORDS_AND_MARKS, Run, mix, runs

BUCKETS = 1 << 18
MAX_ROWS = 6_000
#: A draw of more than so many times its size has ids that many rows share.
CROWDED = 4
PASSES = 8
SEED = 7
#: Bytes of text whose words are hashed together; each takes some forty bytes of memory.
SCORE_BYTES = 1 << 18


def _features(run: Run, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row the distinct feature ids and their values."""
    tokens = run.hashes()
    pairs = mix(tokens[1:] - tokens[:-1])
    for a, b in zip(run.first[:-1].tolist(), run.first[1:].tolist()):
        grams = np.concatenate([tokens[a:b], pairs[a:max(a, b - 1)]])
        ids, times = np.unique(grams % np.uint64(buckets), return_counts=True)
        values = np.log1p(times)
        yield ids.astype(np.int32), (values / (np.sqrt((values * values).sum()) or 1.0)).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, passes: int = PASSES,
          alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal weights, the intercept last."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for ids, values, label in rows:
            i, x = np.append(ids, buckets), np.append(values, 1.0)
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(buckets + 1))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_rows: int = MAX_ROWS, passes: int = PASSES) -> np.ndarray:
    """Weights learned from at most about ``max_rows`` labelled rows outside the held-out fold (crc32 mod 3 = 1)."""
    learnable = (labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(fold_of("doc_id", 3) != 1)
                 .select("doc_id", F.col("quality").cast("int").alias("label")).distinct())
    n = learnable.count()
    order = seeded_hex(SEED, "doc_id")
    chosen = learnable.withColumn("_o", order).where(hex_int(F.col("_o"), 1, 8) < int(2**32 * min(1.0, max_rows / max(n, 1))))
    chosen = F.broadcast(chosen)  # about max_rows ids
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    found = docs.select("doc_id").join(chosen, "doc_id").count()
    if found > CROWDED * max_rows:  # an id that many rows share is drawn with all of them: rows are drawn by their texts too
        by_text = hex_int(seeded_hex(SEED, "doc_id", F.md5(F.col("text").cast("binary"))), 1, 8)
        texts = texts.where(by_text < int(2**32 * max_rows / found)).distinct()

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = [], []
            for run in runs(batch.column("text"), classes=WORDS_AND_MARKS, run_bytes=SCORE_BYTES):
                for i, x in _features(run, buckets):
                    ids.append(i)
                    values.append(x)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("_o"), batch.column("label"), pa.array(ids, pa.list_(pa.int32())),
                                                  pa.array(values, pa.list_(pa.float32()))], ["_o", "label", "ids", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for o, y, i, x in zip(batch.column("_o").to_pylist(), batch.column("label").to_pylist(), batch.column("ids"), batch.column("x")):
                rows.append((o, y, i.values.to_numpy(), x.values.to_numpy()))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        w = train([(i, x, y) for _, y, i, x in rows], buckets, passes)
        k = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(w[k])], ["k", "w"])

    features = texts.select("text", "_o", "label").mapInArrow(featurise, "_o string, label int, ids array<int>, x array<float>")
    got = features.repartition(1).mapInArrow(learn, "k long, w double").toPandas()  # at most buckets + 1 rows
    w = np.zeros(buckets + 1)
    w[got.k] = got.w
    return w


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with score and predicted (1 if score >= threshold); only texts go to Python, only scores come back."""
    buckets = len(weights) - 1

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        scores = [weights[buckets] + weights[i] @ x for run in runs(texts, classes=WORDS_AND_MARKS, run_bytes=SCORE_BYTES)
                  for i, x in _features(run, buckets)]
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(np.array(scores, float), -35, 35))))

    return docs.drop("score", "predicted").withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
