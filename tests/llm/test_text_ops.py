"""Operators 1, 2, 6 and 7 against brute force and held-out accuracy."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tenure.llm import ftrl, langid, logratio, packing, queries
from tenure.llm.shared import table
from tenure.llm.textbatch import RUN_BYTES, WORDS_AND_MARKS, mix, runs, windows

SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("run_bytes", [4, 64, RUN_BYTES])
def test_words_of_runs(run_bytes):
    texts = ["a b\tc", " ", "", None, "é x" * 3, "x" * (RUN_BYTES + 5) + " y", "\x1cq z\x0bw", "a", "b"]
    got = [[bytes(r.data[r.starts[k]:r.ends[k]]).decode() for k in range(r.first[i], r.first[i + 1])]
           for r in runs(pa.array(texts), run_bytes=run_bytes) for i in range(r.hi - r.lo)]
    assert got == [WORD.findall(t or "") for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    big = "w" * (RUN_BYTES + 9)
    texts = ["the cat", "cat the " + "x" * RUN_BYTES + " the", f"{big} cat {big}"]
    seen = {}
    for r in runs(pa.array(texts)):
        for k, h in enumerate(r.hashes().tolist()):
            assert seen.setdefault(bytes(r.data[r.starts[k]:r.ends[k]]), h) == h
    assert len(set(seen.values())) == len(seen) == 4


def test_unit_ids_equal_whole_text_ids():
    random.seed(3)
    some = list("abcXYZ019 .,'!'-*$\n\t\x0b\x1c\x85 éÉß…’Σσ̸́=<>\U0001f642漢ǅİ№½") + ["'s", "'re", " '", "don't", "THE", "<|endoftext|>", "가"]
    texts = ["".join(random.choice(some) for _ in range(random.randint(0, 40))) for _ in range(4000)] + [None, "", "a" * 5000]
    coder = packing.WordIds(packing.default_tokenizer())
    for t, ids in zip(texts, coder.documents(pa.array(texts))):
        assert ids.tolist() == [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def _check_packing(rows, texts):
    """rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; texts: (doc_id, text)."""
    coder = packing.WordIds(packing.default_tokenizer())
    want = Counter()
    for doc_id, ids in zip((d for d, _ in texts), coder.documents(pa.array([t for _, t in texts], pa.string()))):
        for a in range(0, len(ids), 4096):
            want[(doc_id, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].astype("<u4").tobytes()), len(ids))] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values(), default=0) <= 4096
    return 1 - sum(at.values()) / (4096 * max(len(at), 1))


def test_packing_of_documents(sp):
    docs = table(sp, SF01, "documents")
    padding = _check_packing(queries.QUERIES["op1_packing"](sp, SF01).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert padding < 0.05


def test_packing_odd_and_empty(sp, odd_docs):
    rows = packing.pack_documents(odd_docs, with_ids=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids").collect()
    _check_packing(rows, [tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack_documents(odd_docs.limit(0)).count() == 0


def test_nnls_and_best_fit():
    rng = np.random.default_rng(1)
    a = rng.random((12, 30))
    x = packing.nnls(a, b := rng.random(12) * 9)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max(initial=0) < 1e-6
    assert packing.combinations(4) == [((1, 1), (3, 1)), ((1, 2), (2, 1)), ((1, 4),), ((2, 2),), ((4, 1),)]
    rooms = Counter()
    for (s, at), n in zip(packing.best_fit(lengths := [7, 5, 5, 3, 3, 2, 10], 10), lengths):
        assert 0 <= at and at + n <= 10
        rooms[s] += n
    assert max(rooms.values()) <= 10 and len(rooms) == 4


def test_language_held_out_accuracy(sp):
    docs = table(sp, SF01, "documents")
    got = queries.QUERIES["op2_language_id"](sp, SF01).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    out = [r for r in got if r["held_out"]]
    assert out and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_a_few_words_and_ties():
    predict = langid.predictor({"bb": b"delta alpha gamma beta " * 20, "aa": b"lorem ipsum dolor amet " * 20})
    assert predict("Gamma.")[:1] == ("bb",) and predict("ipsum")[:1] == ("aa",)
    lang, score, accepted, margin = predict("qqq")  # fits neither: the language with the most documents, not accepted
    assert (lang, score, accepted, margin) == ("bb", 0.5, False, 0.0)


def test_language_order_follows_the_documents(sp):
    rows = [(i, f"{'uno dos tres cuatro' if i % 3 else 'one two three four'} {i * 7919}", "es" if i % 3 else "en") for i in range(300)]
    learnt = langid.learn(sp.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(learnt) == ["es", "en"] and b"one two" in learnt["en"]


def test_every_language_gets_a_dictionary(sp):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    words = {letters: [word(letters) for _ in range(400)] for letters in ("abcdefg", "hijklmn")}
    prose = lambda letters, n: " ".join(rng.choice(words[letters]) for _ in range(n))
    rows = [(prose("abcdefg", 80), "short") for _ in range(20)] + [(prose("hijklmn", 3000), "long") for _ in range(20)]
    rows += [("opq rst " * 200, "repeated")] * 20 + [("1 " * 9000 + "uvw xyz " * 40, "late")] * 20 + [("123", "no letter")] * 20
    docs = sp.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    learnt = langid.learn(docs)
    assert set(learnt) == {"short", "long", "repeated", "late"} and max(map(len, learnt.values())) <= langid.DICT_BYTES
    got = langid.predict_languages(docs.where("lang <> 'no letter'"), learnt).where("lang <> lang_pred").count()
    assert got == 0


def test_more_languages_than_have_dictionaries_of_full_size(sp):
    n = langid.WHOLE_LANGS + 44
    ids = [i for i in range(8 * n) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = sp.createDataFrame([(d, f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]} words of it", f"l{k}") for k, d in zip((i % n for i in range(len(ids))), ids)],
                              "doc_id long, text string, lang string")
    learnt = langid.learn(docs, dict_bytes=4096, docs_per_lang=4)
    assert len(learnt) == n and max(map(len, learnt.values())) <= 4096 * langid.WHOLE_LANGS // n


def test_language_odd_and_empty(sp, odd_docs):
    content = langid.learn(table(sp, SF01, "documents"))
    got = langid.predict_languages(odd_docs, content).collect()
    assert len(got) == odd_docs.count() and "topic" in got[0].asDict()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert langid.learn(odd_docs.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.predict_languages(odd_docs, {}).collect()} == {"und"}
    assert langid.predict_languages(odd_docs.limit(0), content).count() == 0


def _plain_language(docs):
    """Dictionaries and predictions row by row, with the texts normalised by a pattern."""
    def normal(text):
        out = re.sub(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+", " ", (text or "").lower()).strip(" ").encode()
        return out if any(c.isalpha() for c in text or "") else b""

    learn = [d for d in docs if d["text"] is not None and d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2]
    counts = Counter(d["lang"] for d in learn)
    content = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        parts = {False: b"", True: b""}
        for o, d in sorted(((hashlib.md5(f"2|{d['doc_id']}".encode()).hexdigest(), d) for d in learn if d["lang"] == lang), key=lambda x: x[0]):
            if int(o[:8], 16) >= 2**32 * min(1.0, langid.DOCS_PER_LANG / counts[lang]):
                continue
            text, n = d["text"], len(d["text"].encode())
            if n > langid.DOC_BYTES:
                chars = max(1, langid.DOC_BYTES * len(text) // n)
                at = int(o[8:16], 16) % (len(text) - chars + 1)
                text = text[at:at + chars]
            text = normal(text)
            varied = len(zlib.compress(text)) >= 0.3 * len(text)
            if text and len(parts[varied]) < langid.DICT_BYTES:
                parts[varied] += text + b" "
        content[lang] = (parts[True] or parts[False])[:langid.DICT_BYTES]

    def size(lang, data):
        params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=4096, dict_size=len(content[lang]), min_match=langid.MIN_MATCH,
                                                                write_content_size=0, write_checksum=0, write_dict_id=0)
        coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        return sum(len(coder.compress(data[i:i + 4096] + b" " * 64)) for i in range(0, len(data), 4096))

    for d in docs:
        data = normal(d["text"])
        sizes = {lang: size(lang, data) for lang in content}
        yield d["doc_id"], min(sizes, key=sizes.get) if data else "und"


def test_language_by_brute_force(sp):
    docs = sp.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r["lang_pred"] for r in queries.QUERIES["op2_language_id"](sp, "/root/testdata/sf0.001").collect()}
    assert got == dict(_plain_language(docs))


def test_drawn_ids_that_many_rows_share_do_not_flood_the_sample(sp):
    def hot(seed, fold):  # the id that is drawn first
        return min((i for i in range(2_000) if zlib.crc32(str(i).encode()) % fold[0] != fold[1]), key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())

    def docs(i):
        rows = [(i if k % 3 else 10_000 + k, f"some words of row {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{k}", "en") for k in range(6_000)]
        return sp.createDataFrame(rows + [(i, "equal words", "en")] * 4_000, "doc_id long, text string, lang string")

    learned = langid.learn(docs(hot(2, (4, 2))), docs_per_lang=40)["en"]
    assert 100 < len(learned) < 5_000 and learned.count(b"equal words") <= 1  # all rows of the id would fill 70 KB
    i = hot(7, (3, 1))
    labels = sp.createDataFrame([(10_000 + k, k % 2) for k in range(0, 6_000, 3)] + [(i, 0)] * 500, "doc_id long, quality long")
    weights = ftrl.fit(docs(i), labels, max_rows=50)
    assert np.isfinite(weights).all() and 0 < np.count_nonzero(weights) < 4_000


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def _check_rules(rows):
    for r in rows:
        base = _base(r["text"])
        assert tuple(r[c] for c in logratio.OUTPUTS) == base
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= logratio.THRESHOLD)


def test_quality_rules_base_counts_and_verdicts(sp):
    docs, labels = table(sp, SF01, "documents"), table(sp, SF01, "labels")
    rows = logratio.quality_rules(docs, labels).join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    _check_rules(rows)
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) / len(good) > 0.99 and sum(r["kept"] for r in bad) / len(bad) < 0.1


def test_log_ratio_counts_by_brute_force(sp, odd_docs):
    labels = sp.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 1, 0), (2, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = logratio.ngram_counts(odd_docs, logratio.trusted_documents(labels)).agg(F.sum("raw"), F.sum("target")).first()
    grams = lambda t: max(0, 2 * len(WORD.findall(t or "")) - 1)
    rows = odd_docs.collect()
    assert got[0] == sum(grams(r["text"]) for r in rows) and got[1] == sum(grams(r["text"]) for r in rows if r["doc_id"] in (1, 7))
    out = logratio.quality_rules(odd_docs, labels)
    assert out.schema["kept"].dataType.simpleString() == "boolean" and out.schema["size"].dataType.simpleString() == "string"
    _check_rules(out.collect())
    assert {r["score"] for r in logratio.quality_rules(odd_docs, labels.limit(0)).collect()} == {0.0}
    assert logratio.quality_rules(odd_docs.limit(0), labels).count() == 0


def test_quality_rules_score_every_document_as_brute_force_does(sp):
    docs = table(sp, SF01, "documents").select("doc_id", "text").collect()
    trusted = {r["doc_id"] for r in table(sp, SF01, "labels").where("quality = 1").collect()}
    words = sorted({w for d in docs for w in WORD.findall(d["text"] or "")})
    code = dict(zip(words, (int(h) for r in runs(pa.array(words)) for h in r.hashes())))

    def grams(text):
        codes = np.array([code[w] for w in WORD.findall(text or "")], np.uint64)
        return [int(g) % logratio.BUCKETS for g in (*codes, *windows(codes, 2))]

    raw, target = Counter(), Counter()
    for d in docs:
        raw.update(grams(d["text"]))
        target.update(grams(d["text"]) if d["doc_id"] in trusted else [])
    share = sum(target.values()) / sum(raw.values())
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_quality_rules"](sp, SF01).collect()}
    assert len(got) == len(docs)
    for d in docs:
        g = grams(d["text"])
        score = sum(math.log((target[b] + 5.0) / (raw[b] * share + 5.0)) for b in g) / max(len(g), 1)
        r = got[d["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["kept"] == (not r["base_failed"] and r["score"] >= -0.1)
        assert abs(score + 0.1) < 1e-9 or (r["score"] >= -0.1) == (score >= -0.1)


def test_classifier_by_brute_force(sp):
    docs = table(sp, SF01, "documents").select("doc_id", "text")
    weights = ftrl.fit(docs, table(sp, SF01, "labels"))
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op7_quality_classifier"](sp, SF01).collect()}
    for d in docs.collect():
        (run,) = runs(pa.array([d["text"]], pa.string()), classes=WORDS_AND_MARKS)
        tokens = run.hashes()
        times = Counter(int(g) % ftrl.BUCKETS for g in (*tokens, *mix(tokens[1:] - tokens[:-1])))
        length = math.sqrt(sum(math.log1p(k) ** 2 for k in times.values())) or 1.0
        z = weights[-1] + sum(weights[i] * math.log1p(k) / length for i, k in times.items())
        assert got[d["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_ftrl_updates_by_brute_force():
    rng = random.Random(5)
    rows = [({rng.randrange(20): rng.random() for _ in range(4)}, rng.randrange(2)) for _ in range(60)]
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.02 else -(z[i] - math.copysign(0.02, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.02)

    for _ in range(3):
        for x, y in rows:
            x = {**x, 20: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w[i]
                n[i] += g * g
    got = ftrl.train([(np.array([*x], int), np.array([*x.values()]), y) for x, y in rows], buckets=20, passes=3)
    assert got == pytest.approx([weight(i) for i in range(21)], abs=1e-9)


def test_classifier_held_out_accuracy(sp):
    labels = table(sp, SF01, "labels")
    rows = queries.QUERIES["op7_quality_classifier"](sp, SF01).join(labels, "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert out and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in out)
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_ftrl_separates_and_l1_empties():
    rng = np.random.default_rng(0)
    rows = [(np.array([int(y), 5], np.int32), np.array([0.8, 0.6], np.float32), int(y)) for y in rng.integers(0, 2, 400)]
    w = ftrl.train(rows, buckets=8)
    assert w[1] > 0 > w[0] and w[3] == 0
    assert not ftrl.train(rows, buckets=8, l1=1e6).any()


def test_classifier_odd_and_empty(sp, odd_docs):
    labels = sp.createDataFrame([(1, 1, 0), (2, 0, None), (4, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    w = ftrl.fit(odd_docs, labels)
    got = ftrl.score(odd_docs, w).collect()
    empty = 1 / (1 + math.exp(-w[-1]))
    assert len(got) == odd_docs.count() and all(abs(r["score"] - empty) < 1e-12 for r in got if not WORD.search(r["text"] or ""))
    none = ftrl.fit(odd_docs, labels.limit(0))
    assert {r["score"] for r in ftrl.score(odd_docs, none).collect()} == {0.5}
    assert ftrl.score(odd_docs.limit(0), w).count() == 0


def test_scoring_sends_only_texts_to_python_and_only_scores_back(spark, monkeypatch):
    w = np.random.default_rng(3).normal(size=257)
    docs = spark.createDataFrame([(1, "a b c " * 50, "en"), (2, None, "de"), (3, "", None), (3, "x" * 3000 + " y", "fr"), (None, "a b !?", "en")],
                                 "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    got = ftrl.score(docs, w)
    assert got.columns == ["doc_id", "text", "lang", "score", "predicted"]
    plan = got.where("predicted = 1").select("doc_id", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan and plan.count("ArrowEvalPython [") == 1
    scores = sorted(map(str, got.select("doc_id", "score", "predicted").collect()))
    monkeypatch.setattr(ftrl, "SCORE_BYTES", 8)
    assert sorted(map(str, ftrl.score(docs, w).select("doc_id", "score", "predicted").collect())) == scores
    empty = 1 / (1 + np.exp(-w[256]))
    assert {r["score"] for r in got.where("text IS NULL OR text = ''").collect()} == {empty}
