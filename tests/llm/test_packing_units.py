"""Operator 1's memory of units: ids as the tokenizer gives them, bytes compared, common units kept."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tenure.llm import packing


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(packing.default_tokenizer())


def _ids(coder, text):
    return coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_letter_words_have_the_tokenizers_ids(words):
    rng = random.Random(1)
    some = ["".join(rng.choice("etaoinshrdlucmfwypvbgkjqxzETAQ") for _ in range(rng.randint(1, 24))) for _ in range(20_000)]
    some += [t.removesuffix("</w>") for t in words.tokenizer.get_vocab() if t.removesuffix("</w>").isascii() and t.removesuffix("</w>").isalpha()]
    ids, sizes = words.letters.encode([w.encode() for w in some])
    cuts = np.cumsum(sizes)[:-1]
    for w, got in zip(some, np.split(ids, cuts)):
        assert got.tolist() == _ids(words, w), w


def test_mixed_units_keep_their_order(words):
    units = ["plain", "été", "12", "<|endoftext|>", "Word", "...", "a" * 500, "日本", "x"]
    ids, sizes = words._ids([u.encode() for u in units])
    for u, got in zip(units, np.split(ids, np.cumsum(sizes)[:-1])):
        assert got.tolist() == _ids(words, u), u


def test_full_memory_keeps_common_units():
    coder = packing.WordIds(packing.default_tokenizer(), limit=60_000)
    common = "the common words stay here"
    for k in range(30):
        texts = [f"{common} rare{k}x{i} once{i}y{k}" for i in range(40)]
        for text, ids in zip(texts, coder.documents(pa.array(texts))):
            assert ids.tolist() == [*_ids(coder, text), packing.END_ID]
    assert coder.bytes <= 60_000 + 40 * 4 * 300 and all(w.encode() in coder.slot for w in common.split())


def test_units_that_share_a_hash_are_told_apart(monkeypatch, words):
    texts = ["alpha beta gamma", "beta alpha", "delta"]
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    for text, ids in zip(texts, words.documents(pa.array(texts))):
        assert ids.tolist() == [*_ids(words, text), packing.END_ID]
