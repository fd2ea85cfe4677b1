"""Operator 4 and the pipeline against brute force."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenure.llm import jaccard, queries
from tenure.llm.components import connected
from tenure.llm.shared import table
from tenure.llm.sigtree import Tree, linked_pairs, width

SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, num, den):
    """(doc_id, n_shingles, component_id, n_links) of each (doc_id, text)."""
    sets = [_set(t, n) for _, t in rows]
    have, parent, links = {}, list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in have.get(g, ()))
        for j, c in common.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
        for g in s:
            have.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(s), least.get(root(i)) if s else d, links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def _near_copies(seed, families, copies, words):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.randrange(4, words))]
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9)}"
            out.append(" ".join(t))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "num", "den", "unit"), [(3, 90, 100, 512), (5, 80, 100, 512), (3, 1, 2, 4), (1, 2, 3, 2), (2, 1, 1, 512)])
def test_join_by_brute_force(sp, n, num, den, unit):
    rows = _near_copies(n * num, 30, 14, 200)
    got = jaccard.jaccard_join(sp.createDataFrame(rows, "doc_id long, text string"), n, num, den, unit)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, n, num, den)


def test_join_of_documents(sp):
    rows = [tuple(r) for r in table(sp, SF01, "documents").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.QUERIES["op4_ngram_jaccard"](sp, SF01).collect()) == brute(rows, 3, 90, 100)


def test_join_odd_and_empty(sp, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in jaccard.jaccard_join(odd_docs).collect()) == brute(rows, 3, 90, 100)
    assert jaccard.jaccard_join(odd_docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_join(odd_docs, num=1, den=3)


def test_linked_sets_share_a_part_token():
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100), (1, 2)):
        for _ in range(300):
            n = int(rng.integers(2, 400))
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            drop, add = (int(x) for x in rng.integers(0, max(2, n // 6), 2))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if len(b) and den * common >= num * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
                assert len(np.intersect1d(jaccard.part_tokens(a, num, den), jaccard.part_tokens(b, num, den)))


def test_trees_find_every_link():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 5000, rng.integers(1, 300), dtype=np.uint64)) for _ in range(25)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.05], b[:1], rng.integers(0, 5000, 3, dtype=np.uint64)])) for b in base for _ in range(6)]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 8 * (len(sets[i]) + len(sets[j]) - c)}
    bits = width(sets)
    got = [(max(p), min(p)) for a, b in linked_pairs(Tree(sets, bits), None, 8, 10) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    cross = {(i, j + 70) for a, b in linked_pairs(Tree(sets[:70], bits), Tree(sets[70:], bits), 8, 10) for i, j in zip(a.tolist(), b.tolist())}
    assert cross == {(j, i) for i, j in want if j < 70 <= i}


def test_components(sp):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (None, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["label"] for r in connected(sp.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected(sp.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_edges_whose_hashes_add_up_beyond_a_long(sp):
    pairs = sp.range(9_000).select(F.col("id").alias("b"), (F.col("id") + 10_000).alias("a")).where(F.xxhash64("a", "b") > 2**62)
    n = pairs.count()
    assert n > 1_200  # the sum of their hashes, a 256th of each, passes 2^63
    assert connected(pairs).where("label = node % 10000").count() == 2 * n


def test_pipeline_stages(sp):
    docs = table(sp, SF01, "documents")
    quality = {r["doc_id"]: r["quality"] for r in table(sp, SF01, "labels").collect()}
    (_, classify), (_, rules), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    first = classify(sp, docs, SF01)
    ids = {r["doc_id"] for r in first.collect()}
    assert first.columns == docs.columns
    good, bad = [d for d, q in quality.items() if q == 1], [d for d, q in quality.items() if q == 0]
    assert sum(d in ids for d in good) / len(good) > 0.98 and sum(d in ids for d in bad) / len(bad) < 0.1
    second = rules(sp, first, SF01)
    assert second.columns == docs.columns and second.count() < first.count()
    third = near(sp, docs, SF01)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in third.collect()} == {d for d, _, c, _ in brute(rows, 5, 80, 100) if d == c} and third.columns == docs.columns
    fourth = mix(sp, docs, SF01)
    want = {r["doc_id"] for r in queries.QUERIES["op10_mixing"](sp, SF01).where("sampled").collect()}
    assert {r["doc_id"] for r in fourth.collect()} == want and fourth.columns == docs.columns
    assert {r["doc_id"] for r in pack(sp, fourth, SF01).select("doc_id").collect()} == want


def test_pipeline_runs_whole_and_over_odd_rows(sp, odd_docs):
    assert corpus_pipeline.run(sp, SF01).count() > 0
    for docs in (odd_docs, odd_docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(sp, docs, SF01)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() <= docs.count()
    twice = corpus_pipeline.STAGES[2][1](sp, odd_docs, SF01)
    assert twice.where("doc_id = 1").count() == 1 and twice.where("doc_id IS NULL").count() == 1


def test_profiles_do_not_depend_on_run_bytes_and_leave_run_by_run(sp, monkeypatch):
    texts = ["a b c d e f", None, "", "g " * 40, "A b c d e f", "x" * 900 + " y z"]
    docs, left = sp.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1), []
    whole = sorted(map(str, jaccard.profiles(docs, 3, 90, 100).collect()))
    monkeypatch.setattr(jaccard, "RUN", 16)
    assert sorted(map(str, jaccard.profiles(docs, 3, 90, 100).collect())) == whole and len(whole) == 6
    batch = jaccard.pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": texts})
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: left.extend(b.num_rows for b in f(iter([batch]))))
    jaccard.profiles(docs, 3, 90, 100)
    assert sum(left) == 6 and len(left) > 2
