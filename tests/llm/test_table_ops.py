"""Operators 3, 5, 8, 9, 10 against brute force, round trips and oracle SQL."""
import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tenure.llm import lshforest, mixing, queries, sharding, urlfilter, warc
from tenure.llm.shared import drop_written, table

SF01 = "/root/testdata/sf0.01"


def _oracle(name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    got = con.execute(queries.ORACLES[name])
    names = [d[0] for d in got.description]
    return Counter(tuple(sorted(zip(names, r))) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(sp, name):
    rows = queries.QUERIES[name](sp, SF01).collect()
    assert Counter(tuple(sorted(r.asDict().items())) for r in rows) == _oracle(name)


def _digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def _pages(sp):
    rows = [(5, "http://a/b c\r\nX: y", "<p>é</p>", "x"), (2, None, "<p>é</p>", "x"), (9, "http://z", None, "x"), (3, "u", "", "x"), (4, "u", "WARC/1.1\r\n\r\n", "x"),
            (None, "n", "<p>é</p>", "x"), (None, "n", "only null ids", None), (None, "m", "only null ids", None), (7, "u", "long " * 50_000, "x"), (7, "u", "long " * 50_000, "x")]
    return sp.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_warc_round_trip_of_odd_pages(sp, tmp_path):
    pages = _pages(sp)
    warc.write_archives(pages, str(tmp_path / "a"), records_per_file=3)
    rows = warc.read_archives(sp, str(tmp_path / "a")).collect()
    assert {r["kind"] for r in rows} == {"record"} and len(rows) == pages.count()
    want = Counter()
    first = {}
    for r in pages.collect():
        b = (r["html"] or "").encode()
        if r["page_id"] is not None:
            first[b] = min(first.get(b, r["page_id"]), r["page_id"])
    for r in pages.collect():
        b = (r["html"] or "").encode()
        revisit = b in first and r["page_id"] != first[b]
        want[(f"<urn:page:{'' if r['page_id'] is None else r['page_id']}>", "revisit" if revisit else "response", f"<urn:page:{first[b]}>" if revisit else None,
              _digest(b), len(b), b"" if revisit else b)] += 1
    got = Counter((r["record_id"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], bytes(r["payload"])) for r in rows)
    assert got == want
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(sp, str(tmp_path / "e")).count() == 0
    warc.write_archives(pages, str(tmp_path / "l"), least_bytes=1 << 30)
    assert warc.read_archives(sp, str(tmp_path / "l")).where("record_type = 'revisit'").count() == 0


def test_warc_round_trip_of_long_urls(sp, tmp_path):
    urls = {1: "http://a/" + "x" * 100_000, 2: "http://a/" + " \n" * 50_000, 3: "http://a/WARC/1.1", 4: "http://a/" + "WARC/1.1\r\n" * 9_000}
    pages = sp.createDataFrame([(i, u, "<p>same</p>") for i, u in urls.items()], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "u"))
    rows = warc.read_archives(sp, str(tmp_path / "u")).collect()
    assert {r["kind"] for r in rows} == {"record"}
    coded = {f"<urn:page:{i}>": u.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") for i, u in urls.items()}
    assert {r["record_id"]: r["target_uri"] for r in rows} == coded
    assert Counter((r["record_type"], r["refers_to"]) for r in rows) == {("response", None): 1, ("revisit", "<urn:page:1>"): 3}


def test_headers_without_an_end_stop_at_the_next_version_line():
    cut = b"WARC/1.1\r\nWARC-Type: response\r\n"
    rows = list(warc.salvage(cut + _record(1, b"x") + cut))
    assert [(a, b, h and h["warc-record-id"]) for a, b, h, _, _ in rows] == [
        (0, len(cut), None), (len(cut), rows[1][1], "<urn:page:1>"), (rows[1][1], rows[1][1] + len(cut), None)]


def _record(i, payload):
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{_digest(payload)}\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_recovers_later_records_and_logs_every_lost_byte(zipped):
    random.seed(1)
    pack = gzip.compress if zipped else bytes
    parts = [pack(_record(i, random.randbytes(300) + b"WARC/1.1\r\n" + str(i).encode())) for i in range(9)]
    starts = np.cumsum([0, *map(len, parts)])
    data = bytearray(b"".join(parts))
    for i in (2, 3, 6):  # spoil payloads
        data[starts[i] + len(parts[i]) // 2] ^= 0x55
    data = bytes(data[:starts[5]] + b"junk between" + data[starts[5]:starts[8] + 40])  # and cut the last record
    rows = list(warc.salvage(data))
    kept = [h["warc-record-id"] for _, _, h, _, _ in rows if h]
    assert kept == [f"<urn:page:{i}>" for i in (0, 1, 4, 5, 7)]
    at = 0
    for start, end, h, _, reason in rows:
        assert start == at and (h is None) == (reason is not None)
        at = end
    assert at == len(data) and sum(h is None for _, _, h, _, _ in rows) == 4


def test_salvage_of_nothing_and_of_noise():
    assert list(warc.salvage(b"")) == []
    assert [(a, b, h) for a, b, h, _, _ in warc.salvage(b"\x1f\x8b\x08 no member")] == [(0, 13, None)]
    assert [h for _, _, h, _, _ in warc.salvage(_record(1, b"x").replace(b"Content-Length: 1", b"Content-Length: one"))] == [None]


def test_long_records_go_to_files_of_their_own(sp, tmp_path):
    pages = sp.createDataFrame([(i, f"http://a/{i}", str(i) * (9_000 if i % 4 == 0 else 10)) for i in range(1, 41)], "page_id long, url string, html string")
    path = tmp_path / "f"
    n = warc.write_archives(pages.coalesce(1), str(path), lengths=(4_096, 12_000), file_bytes=24_000)
    files = list(path.glob("*.txt"))
    assert n == 40 and all(f.stat().st_size <= 24_000 for f in files) and len(files) > 10
    one = warc.write_archives(pages.coalesce(1), str(tmp_path / "g"), lengths=(4_096,), file_bytes=24_000)  # longer than all classes: alone
    assert one == 40 and sum(f.stat().st_size > 8_000 for f in (tmp_path / "g").glob("*.txt")) == 10
    assert warc.read_archives(sp, str(path)).where("kind = 'record'").select("record_id").distinct().count() == 40


def test_salvage_of_a_noisy_file_searches_it_once():
    class Counted(bytes):
        looked = 0

        def find(self, mark, start=0):
            at = bytes.find(self, mark, start)
            Counted.looked += (at if at >= 0 else len(self)) - start
            return at

    noise = b"WARC/1.x " * 20_000 + _record(1, b"x")
    rows = list(warc.salvage(Counted(noise)))
    assert [h is None for _, _, h, _, _ in rows] == [True, False] and rows[0][1] == rows[1][0]
    assert Counted.looked <= 3 * len(noise)


def _check_shards(rows, n, shards=24):
    assert Counter(r["law"] for r in rows) == Counter({"rows": n})
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min([*sizes.values()] if len(sizes) == shards else [0]) <= 1
    for s, k in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k))


def test_sharding_by_brute_force(sp):
    rows = queries.QUERIES["op5_sharding"](sp, SF01).collect()
    docs = table(sp, SF01, "documents").collect()
    texts = {d["doc_id"]: d["text"].encode() for d in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    _check_shards(rows, len(docs))
    by_source = defaultdict(list)
    for d in docs:
        b = texts[d["doc_id"]]
        by_source[d["source"]].append((hashlib.md5(f"5|{d['doc_id']}|{zlib.crc32(b)}|{len(b) + 8}".encode()).hexdigest(), d["doc_id"]))
    order = sorted(((r + 0.5) / len(v), s, r, i) for s, v in by_source.items() for r, (_, i) in enumerate(sorted(v)))
    assert {i: k * 24 // len(docs) for k, (_, _, _, i) in enumerate(order)} == {r["doc_id"]: r["shard"] for r in rows}


@pytest.mark.parametrize("slice_rows", [1, 3, 20_000])
def test_sharding_odd_and_empty(sp, odd_docs, slice_rows):
    out = sharding.interleave(odd_docs, shards=5, rows_per_slice=slice_rows)
    rows = out.collect()
    _check_shards(rows, odd_docs.count(), 5)
    assert out.schema["size"].dataType.simpleString() == "bigint" and {"score", "topic", "kept"} <= set(out.columns)
    assert sharding.interleave(odd_docs.limit(0)).count() == 0
    _check_shards(sharding.interleave(odd_docs, shards=40).collect(), odd_docs.count(), 40)


@pytest.mark.parametrize("slice_rows", [1, 7, 10_000])
def test_sharding_of_many_small_sources(sp, slice_rows):
    """Sources from one row to most of the table: places equal the plain sort by fractional rank, whatever the slices."""
    docs = [(i, f"t{i}", "big" if i % 3 else f"s{i % 90}" if i % 2 else f"own{i}") for i in range(600)]
    got = sharding.interleave(sp.createDataFrame(docs, "doc_id long, text string, source string"), shards=7, rows_per_slice=slice_rows).collect()
    by_source = defaultdict(list)
    for i, t, source in docs:
        by_source[source].append((hashlib.md5(f"5|{i}|{zlib.crc32(t.encode())}|{len(t) + 8}".encode()).hexdigest(), i))
    order = sorted(((2 * r + 1) / (2 * len(v)), s, r, i) for s, v in by_source.items() for r, (_, i) in enumerate(sorted(v)))
    assert {r["doc_id"]: r["shard"] for r in got} == {i: k * 7 // 600 for k, (_, _, _, i) in enumerate(order)}
    _check_shards(got, 600, 7)


def test_forest_ascends_many_queries_together():
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((500, 12)) + 1e3 * rng.standard_normal(12)
    rows[100:110] = rows[100]
    rows[7] += 1e-6
    forest = lshforest.Forest(rows, 8, 1)
    asked = np.concatenate([rows[:30], rows[100:102], rows.mean(0)[None]])
    own = np.arange(500)[None] == np.array([*range(30), 100, 101, -1])[:, None]
    exact = np.sqrt(((rows[None] - asked[:, None]) ** 2).sum(2))
    exact[own] = np.inf
    kth = np.sort(exact, axis=1)[:, 4]
    q, r, d = forest.search(asked, own, 5, 0.0)  # nothing may be missed: all that is as near as the fifth
    assert {(a, b) for a, b in zip(q, r)} >= {(a, b) for a, b in zip(*np.nonzero(exact <= kth[:, None]))}
    assert (d == exact[q, r]).all()
    alone = [forest.search(asked[i:i + 1], own[i:i + 1], 5, 0.3) for i in range(len(asked))]  # each query as if alone
    q, r, d = forest.search(asked, own, 5, 0.3)
    for i, (_, r1, _) in enumerate(alone):
        assert sorted(exact[i, r[q == i]])[:5] == sorted(exact[i, r1])[:5]


def _brute(rows, asked, k):
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in rows:
        if q in asked:
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [d for d, _ in near[:k]]
    return out


def test_neighbours_recall(sp):
    got = defaultdict(list)
    rows = table(sp, "/root/testdata/sf0.1", "embeddings")
    for r in lshforest.nearest(rows, rows.where("vec_id % 100 = 0"), block_rows=700).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1 and r["vec_id"] != r["query_id"]
        got[r["query_id"]].append(r["score"])
    want = _brute([(r["vec_id"], r["embedding"]) for r in rows.collect()], {i for i in range(0, 2000, 100)}, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(any(abs(d - x) < 1e-9 for x in got[q]) for q, v in want.items() for d in v)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_neighbours_odd_and_empty(sp):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]),
            (None, [1.0, 0.1]), (100, [0.5, 0.5]), (100, [0.5, 0.4]), (200, [3.0]), (300, []), (8, [float("inf"), 0.0])]
    df = sp.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = [tuple(r) for r in lshforest.nearest(df, df.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 2)]
    assert [g[:3] for g in got if g[0] == 200] == [(200, 1, 7)] and {g[0] for g in got} == {0, 100, 200}
    assert [g[3] for g in got if g[0] == 100][0] == pytest.approx(np.sqrt(0.16 + 0.09))  # from [0.5, 0.4]
    assert lshforest.nearest(df.limit(0), df).count() == 0 and lshforest.nearest(df, df.limit(0)).count() == 0


def test_url_terms_and_rules(sp):
    urls = ["http://x.casino.net/", "http://CASINO-win.example.net/a", "http://casinos.net/", "http://free.net/pills", "http://free.net/free-free", "http://spam.example.org/x",
            "http://example.org/es/1", "http://example.org/en/12", "http://badexample.org/es/1", "http://a.com/fr/casino", "http://a.com/de/x", "http://org", "HTTP://A.ORG/", None, "",
            "no scheme casino", "a://b://casino.com/x", "http://h.com:80/fr/x?y#z", "http://x.net/?q=xxx", "http://x.net/\nporn"]
    df = sp.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df).collect()}
    assert got["http://x.casino.net/"] == ("x.casino.net", "/", None, "block") and got["http://casinos.net/"][3] == "allow"
    assert got["http://CASINO-win.example.net/a"][0::3] == ("casino-win.example.net", "block")
    assert got["http://free.net/pills"][3] == "block" and got["http://free.net/free-free"][3] == "allow"
    assert got["http://spam.example.org/x"][2:] == ("org/", "allow") and got["http://example.org/es/1"][2:] == ("example.org/es/", "block")
    assert got["http://example.org/en/12"][2:] == ("example.org/en/1", "block") and got["http://badexample.org/es/1"][2:] == ("org/", "allow")
    assert got["http://a.com/fr/casino"][2:] == ("com/fr/", "allow") and got["http://a.com/de/x"][2:] == ("com/de/", "block")
    assert got["http://org"] == ("org", "", None, "allow") and got["HTTP://A.ORG/"][2] == "org/"
    assert got[None] == ("", "", None, "allow") and got[""][:2] == ("", "") and got["no scheme casino"] == ("", "", None, "block")
    assert got["a://b://casino.com/x"][:2] == ("b:", "//casino.com/x") and got["http://h.com:80/fr/x?y#z"][:3] == ("h.com:80", "/fr/x", None)
    assert got["http://x.net/?q=xxx"][3] == "block" and got["http://x.net/\nporn"][1::2] == ("/\nporn", "block")
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_raking_meets_its_targets(sp):
    want = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"t": 1.0}}
    cells = sp.createDataFrame([(s, g, "t", 10 + 7 * i) for i, (s, g) in enumerate((s, g) for s in "abc" for g in ("en", "de"))], "_source string, _lang string, _topic string, _t long")
    rows = mixing.rake(cells, want, passes=30).collect()
    total = sum(r["_w"] for r in rows)
    assert total == pytest.approx(sum(r["_t"] for r in rows))
    for margin, shares in want.items():
        for value, share in shares.items():
            assert sum(r["_w"] for r in rows if r[f"_{margin}"] == value) / total == pytest.approx(share, abs=1e-6)


@pytest.mark.parametrize("lang", ["en", "xx"])
def test_a_rare_cell_does_not_thin_out_the_corpus(sp, lang):
    docs = table(sp, SF01, "documents").select("doc_id", "text", "lang", "source")
    rare = docs.union(sp.createDataFrame([(10**9, "five tokens of new source", lang, "a new source")], docs.schema))
    (_, mix), = [s for s in corpus_pipeline.STAGES if "mixing" in s[0]]
    assert abs(mix(sp, rare, SF01).count() - mix(sp, docs, SF01).count()) < 0.01 * docs.count()
    for tolerance in (None, 0.01):
        plain, out = (mixing.mix_sources(d, tolerance=tolerance) for d in (docs, rare))
        kept, total = out.selectExpr("sum(n_tokens * probability)", "sum(n_tokens)").first()
        assert kept == pytest.approx(mixing.SHARE * total) and out.where("probability > 1").count() == 0
        assert out.where("source = 'a new source'").first()["probability"] == 1.0
        assert abs(out.where("sampled").count() - plain.where("sampled").count()) < 0.01 * docs.count()


def test_keep_rate_reaches_its_share(sp):
    rng = random.Random(5)
    some = [(rng.randint(1, 1000), rng.choice([0.0, rng.random() * 900, 20.0])) for _ in range(40)]
    cells = sp.createDataFrame([(t, float(w)) for t, w in some], "_t long, _w double")
    total = sum(t for t, _ in some)
    for share in (0.0, 0.05, 0.3, 0.6):
        r = mixing.keep_rate(cells, share)
        assert sum(t * min(1.0, r * w / t) for t, w in some) == pytest.approx(share * total)
    whole = mixing.keep_rate(cells, 1.0)  # more than the cells of any weight hold: all of those
    assert all(whole * w / t >= 1 - 1e-9 for t, w in some if w > 0)


def test_raking_goes_on_until_the_margins_fit(sp, caplog):
    rows = [(s, g, "t", n) for s, g, n in (("a", "en", 10**6), ("a", "de", 10), ("b", "en", 10), ("b", "de", 10), ("c", "en", 3))]
    cells = sp.createDataFrame(rows, "_source string, _lang string, _topic string, _t long")
    want = {"source": {"a": 0.5, "b": 0.4, "c": 0.1}, "lang": {"en": 0.5, "de": 0.5}, "topic": 1.0}
    assert mixing.margin_gap(mixing.raked_cells(cells, want, passes=1)) > 0.001
    assert mixing.margin_gap(mixing.raked_cells(cells, want, passes=1, tolerance=0.001)) <= 0.001 and not caplog.records
    apart = cells.where("_source <> _lang AND (_source = 'c') = (_lang = 'en') AND _source <> 'a'")  # b only de, c only en
    mixing.raked_cells(apart, {"source": {"b": 0.9, "c": 0.1}, "lang": {"en": 0.5, "de": 0.5}, "topic": 1.0}, tolerance=0.001)
    assert "cannot all be met" in caplog.text


def test_mixing_odd_and_empty(sp, odd_docs):
    out = mixing.mix_sources(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 < r["probability"] <= 1 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1} and len({r["sampled"] for r in rows if r["doc_id"] == 1}) == 1
    none = mixing.mix_sources(odd_docs, {"source": {"a": 1.0}, "lang": 1.0, "topic": 1.0}).collect()
    assert all(r["sampled"] is False and r["gain"] == 0 for r in none if r["source"] != "a")
    assert mixing.mix_sources(odd_docs.limit(0)).count() == 0


def test_drop_written(sp, odd_docs):
    mixing.mix_sources(odd_docs)
    assert drop_written(sp) >= 1 and drop_written(sp) == 0
