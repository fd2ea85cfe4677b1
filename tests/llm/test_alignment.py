"""Operator 11 against a plain per-document alignment."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tenure.llm import alignment, queries
from tests.llm.plain import as_rows

TEXTS = [None, "", " ", "  two  spaces ", "plain words here", "Ünïcödé ça 日本語 \U0001f600!", "tab\tnew\nline", "<s> </s> <|endoftext|> <unk>",
         "▁ block", "\x00 nul", "<0x41> byte", "é combining", "ﬁ ligature ①", "plain words here", "a" * 3000, "x y " * 500, "don't we'll I'm"]


def _plain(texts):
    """Per text: tokens by the named files, groups by walking both ends, links by comparing all ranges of a group."""
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = alignment._byte_of_char()
    piece = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for text in texts:
        groups, links = [], []
        if text:
            want = b" " + text.encode()
            a = [(i, bytes(back[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, piece(i)) for i in b_tok.encode(text)]
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                spans = []
                for tokens in (a, b):
                    at, got = 0, []
                    for i, x in tokens:
                        got.append((at, at + len(x), i))
                        at += len(x)
                    spans.append(got)
                at = [0, 0]
                for cut in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
                    pair = []
                    for k, s in enumerate(spans):
                        lo = at[k]
                        while at[k] < len(s) and s[at[k]][1] <= cut:
                            at[k] += 1
                        pair.append(s[lo:at[k]])
                    ga, gb = pair
                    groups.append((ga, gb))
                    links += [(x[2], y[2]) for x in ga for y in gb if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        out.append((groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for groups, links in out:
        text = ";".join(",".join(str(t[2]) for t in ga) + "|" + ",".join(str(t[2]) for t in gb) for ga, gb in groups)
        rows.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                     sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows, out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_plain(sp, limit):
    df = sp.createDataFrame([(i if i else None, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = {r["doc_id"] or 0: tuple(r[c] for c in COLUMNS) for r in alignment.align(df, broadcast_pairs=limit).collect()}
    want, _ = _plain(TEXTS)
    assert got == dict(enumerate(want))
    assert got[0] == (0, 0, 0, 0, 0, 0, "") and got[4][0] > 0


def test_given_documents_equal_plain(sp):
    docs = sp.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want, _ = _plain(list(texts.values()))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_alignment"](sp, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip(texts, want))


def test_spans_give_back_the_text(sp):
    df = sp.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    _, plain = _plain(TEXTS)
    for r in alignment.align(df, with_spans=True).collect():
        groups = plain[r["doc_id"]][0]
        assert [(s["start"], s["end"], s["a"], s["b"]) for s in r["spans"]] == [
            (ga[0][0], ga[-1][1], [t[2] for t in ga], [t[2] for t in gb]) for ga, gb in groups]


def test_units_remembered_and_forgotten():
    pair = alignment.Pair(*alignment.default_tokenizers())
    texts = [f"some words. And  more\nwords, {i} numbers a b c isn't it {i % 7} " * 3 for i in range(200)] + TEXTS
    whole = alignment.Units(pair)
    small = alignment.Units(pair, limit=20_000)
    want, _ = _plain(texts)
    for lo in range(0, len(texts), 20):
        a, b = whole.documents(texts[lo:lo + 20]), small.documents(texts[lo:lo + 20])
        assert a["groups_sha256"] == b["groups_sha256"] == [w[6] for w in want[lo:lo + 20]]
        assert a["pairs"].equals(b["pairs"])
        for k, c in enumerate(COLUMNS[:4]):
            assert a[c].tolist() == b[c].tolist() == [w[k] for w in want[lo:lo + 20]]
    assert len(small.slot) < len(whole.slot)


def test_odd_and_empty_tables(sp, odd_docs):
    assert alignment.align(odd_docs.limit(0)).count() == 0
    rows = as_rows(alignment.align(odd_docs))
    texts = [r["text"] for r in odd_docs.collect()]
    want, _ = _plain(texts)
    assert sorted(r[1:5] for r in rows) == sorted(w[:4] for w in want)
