"""Operator 4, n-gram Jaccard join by signature trees.

1. Every document's set of word shingles is made once; documents with equal sets are one class (a 64-bit hash of
   the set), so exact copies cost one row from here on.
2. Routing, exact: within a size level the shingles are dealt into k parts by hash, and a part's content (its
   hash) is a token. Sets that reach the threshold differ in at most d shingles and so in at most d parts, hence
   each class sends its d + 1 strongest part tokens (most shingles first), and linked classes share one (prefix
   filter). A class near its level's upper size also sends tokens for the next level. Classes that share tokens,
   directly or through others, form a cluster; no link leaves a cluster.
3. Each cluster's classes meet in signature trees (``sigtree``) whose dual traversal finds all links exactly.
   A cluster of more than ``UNIT`` classes is cut into blocks, and each pair of blocks is a task's unit of work.
   Units return labels and link counts per class, never pairs.
4. Labels are joined into components, and a component's id is its smallest doc_id.

Defined cases: null and empty texts and texts without words have n_shingles 0, are linked with nothing and are
their own component; fewer words than a shingle make one shingle of all words; repeated rows and repeated ids are
documents like others (equal texts are linked); a null id never names a component unless all its ids are null;
an empty table gives no rows; other columns are ignored. ``n_links`` counts linked documents, copies included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.components import connected
from tenure.llm.shared import written
from tenure.llm.sigtree import Tree, linked_pairs, width
from tenure.llm.textbatch import mix, runs, shingle_sets

UNIT = 512
FILTER_BITS = 1 << 25
SEEN = 1 << 20
#: Bytes of text that are hashed and handed on together; each takes some sixty bytes of memory.
RUN = 1 << 18
_U = np.uint64


def class_of(shingles: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    h = mix(np.array([mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(shingles))], np.uint64))
    return int(h.view(np.int64)[0])


def _tokens(mixed: np.ndarray, level: int, k: int, d: int) -> np.ndarray:
    """The d + 1 strongest of the k part tokens: most shingles first, then by value."""
    part = mixed % _U(k)
    order = np.argsort(part, kind="stable")
    p = part[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    count = np.diff(np.append(first, len(p)))
    token = mix(np.add.reduceat(mix(mixed)[order], first) + p[first] * _U(0x9E3779B97F4A7C15) + mix(count + (level << 40)))
    if len(token) <= d:  # parts without shingles are tokens too, the weakest
        empty = np.setdiff1d(np.arange(k, dtype=np.uint64), p[first])
        token = np.concatenate([token, mix(empty * _U(0x9E3779B97F4A7C15) + mix(np.array([level << 40], np.uint64)))])
        count = np.concatenate([count, np.zeros(len(empty), np.int64)])
    return token[np.lexsort((token, -count))[:d + 1]]


def part_tokens(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """All tokens a set sends. Linked sets (num / den or more) that are not equal share at least one."""
    n, low, both = len(shingles), den - num, den + num
    level = (n - 1).bit_length()
    top, reach = 1 << level, n * den // num
    parts = lambda t: (2 * t * low) // both * 6 // 5 + 1
    mixed, out = mix(shingles), []
    if (d := (n + min(top, reach)) * low // both) > 0:
        out.append(_tokens(mixed, level, parts(top), d))
    if reach > top and (d := (n + reach) * low // both) > 0:
        out.append(_tokens(mixed, level + 1, parts(2 * top), d))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def profiles(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, class (null: no words) and part tokens, which a task sends once per class it remembers."""
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for run in runs(batch.column("text"), lower=True, run_bytes=RUN):
                size, klass, tokens = [], [], []
                for s in shingle_sets(run, words):
                    c = class_of(s) if len(s) else None
                    size.append(len(s))
                    klass.append(c)
                    if c is None or c in seen:
                        tokens.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    tokens.append(part_tokens(s, num, den).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(run.lo, run.hi - run.lo), pa.array(size, pa.int64()), pa.array(klass, pa.int64()),
                                                  pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "class", "tokens"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(profile, "doc_id long, n_shingles long, class long, tokens array<long>")


def clusters(rows: DataFrame) -> DataFrame:
    """(node, label) of the classes that share a part token with another class, directly or through others."""
    sent = rows.where("class IS NOT NULL AND tokens IS NOT NULL").select("class", F.explode("tokens").alias("token"))
    # a token's smallest class by a grouped minimum, written: the join back can then split a hot token
    hubs = written(sent.groupBy("token").agg(F.min("class").alias("hub"), F.max("class").alias("_top")).where("hub <> _top").drop("_top"), "hubs")
    hub = sent.join(hubs, "token").where("class <> hub")
    return connected(hub.select(F.col("class").alias("a"), F.col("hub").alias("b")))


def _places(node, mask: int = FILTER_BITS - 1):
    """Two bit places of a class in the filter."""
    return node & mask, (node >> 32) & mask


def class_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size (``FILTER_BITS``) over class hashes; its words reach the driver."""
    places = nodes.select(F.explode(F.array(F.col("node").bitwiseAND(FILTER_BITS - 1), F.shiftright("node", 32).bitwiseAND(FILTER_BITS - 1))).alias("p"))
    words = (places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("m"))).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.w] = words.m
    return out


def sets_of(docs: DataFrame, words: int, bloom: np.ndarray) -> DataFrame:
    """(class, shingles) of the classes the filter lets pass, once per class a task remembers."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        passes = lambda p: bool((int(bits[p >> 6]) >> (p & 63)) & 1)
        for batch in batches:
            for run in runs(batch.column("text"), lower=True, run_bytes=RUN):
                klass, sets = [], []
                for s in shingle_sets(run, words):
                    if not len(s) or (c := class_of(s)) in seen or not all(passes(p) for p in _places(c)):
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    klass.append(c)
                    sets.append(s.astype("<u8").tobytes())
                if klass:
                    yield pa.RecordBatch.from_arrays([pa.array(klass, pa.int64()), pa.array(sets, pa.binary())], ["class", "shingles"])
    return docs.select("text").mapInArrow(pick, "class long, shingles binary")


def units(cluster: DataFrame, unit: int) -> DataFrame:
    """(node, label, block, i, j): the block pairs each class takes part in; a cluster up to ``unit`` has one."""
    sizes = cluster.groupBy("label").count()
    blocks = cluster.join(sizes, "label").withColumn("n", F.ceil(F.col("count") / unit).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    return (blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .select("node", "label", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), (F.col("n") > 1).alias("split")))


def _join(num: int, den: int):
    def solve(members: list[tuple[int, int, int, np.ndarray]], i: int, j: int) -> tuple[list[int], list[int], list[int]]:
        nodes, weights, sets = [m[0] for m in members], np.array([m[1] for m in members], np.int64), [m[3] for m in members]
        bits = width(sets)
        if i == j:
            side = (np.arange(len(nodes)), None)
            pairs = linked_pairs(Tree(sets, bits), None, num, den)
        else:
            side = tuple(np.array([k for k, m in enumerate(members) if m[2] == b], np.int64) for b in (i, j))
            if not (len(side[0]) and len(side[1])):
                return [], [], []
            pairs = linked_pairs(*(Tree([sets[k] for k in s], bits) for s in side), num, den)
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for a, b in pairs:
            a, b = side[0][a], (side[0] if side[1] is None else side[1])[b]
            np.add.at(links, a, weights[b])
            np.add.at(links, b, weights[a])
            while len(apart := np.flatnonzero(root[a] != root[b])):
                x, y = root[a[apart[0]]], root[b[apart[0]]]
                root[root == max(x, y)] = min(x, y)
        keep = np.flatnonzero(links).tolist()
        return [nodes[k] for k in keep], [nodes[root[k]] for k in keep], links[keep].tolist()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members = None, []

        def out():
            got = solve(members, unit[1], unit[2]) if len(members) > 1 else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got] + [pa.array([split] * len(got[0]), pa.bool_())], ["node", "root", "links", "split"])

        split = False
        for batch in batches:
            cols = [batch.column(c) for c in ("label", "i", "j", "node", "weight", "block", "split")]
            for (label, i, j, node, weight, block, cut), data in zip(zip(*(c.to_pylist() for c in cols)), batch.column("shingles")):
                if (label, i, j) != unit:
                    if unit is not None and len(members) > 1:
                        yield out()
                    unit, members, split = (label, i, j), [], cut
                if not members or members[-1][0] != node:  # tasks may have sent a class twice; the rows are sorted
                    members.append((node, weight, block, np.frombuffer(data.as_buffer(), "<u8").copy()))
        if unit is not None and len(members) > 1:
            yield out()
    return join


def jaccard_join(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, unit: int = UNIT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document; linked: den * |a & b| >= num * |a | b|."""
    if not 0 < den <= 2 * num <= 2 * den:
        raise ValueError("the threshold must be from 1/2 to 1")
    rows = written(profiles(docs, words, num, den), "profiles")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"))
    cluster = clusters(rows)
    work = units(cluster, unit).join(classes.select(F.col("class").alias("node"), "weight"), "node")
    sets = sets_of(docs, words, class_filter(cluster)).withColumnRenamed("class", "node")
    dealt = work.join(sets, "node").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
    found = written(dealt.select("label", "i", "j", "node", "weight", "block", "split", "shingles")
                    .mapInArrow(_join(num, den), "node long, root long, links long, split boolean"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = found.where("NOT split").select("node", F.col("root").alias("label"))
    cut = connected(found.where("split").select(F.col("node").alias("a"), F.col("root").alias("b")))
    label = whole.union(cut)
    info = classes.join(links.withColumnRenamed("node", "class"), "class", "left").join(label.withColumnRenamed("node", "class"), "class", "left")
    info = info.withColumn("label", F.coalesce("label", "class"))
    least = info.groupBy("label").agg(F.min("rep").alias("component"))
    info = info.join(least, "label").select("class", "component", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    return (rows.select("doc_id", "n_shingles", "class").join(info, "class", "left")
            .select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_links")))
