"""Operator 2, language ID: compression with a zstandard raw-content dictionary per language.

Learning takes, per language, documents in the order of a hash of their id until the dictionary has
``dict_bytes``; the candidates are about ``docs_per_lang`` documents of the learning folds (crc32 of the id
mod 4 other than 2, text and lang not null), of those longer than ``DOC_BYTES`` a slice of about that size at a place
drawn by the hash. Those that shrink below 0.3 (repeated words teach little) count only where a language has no others.
Every language with a letter in its learning folds gets a dictionary: one that the draw missed learns from the first
such document by the hash, and beyond ``WHOLE_LANGS`` languages each has a smaller share. A text is lower-cased, ASCII
characters other than letters become spaces, and it is compressed in blocks of ``block_bytes``, each by every
dictionary alone, so the whole text speaks against the dictionaries rather than against its own beginning.
Each block ends in the same run of spaces, without which blocks of a few words would be
stored as they are and have equal sizes. The language with the smallest total wins; ties go to the one with the
most documents to learn from, then to the first name. ``accepted`` is false where the second
best is within ``least_margin`` of the best.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and not accepted, and so are all
texts when nothing could be learned; a null id is neither held out nor learned from; repeated rows are predicted
each on its own. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tenure.llm.shared import fold_of, hex_int, seeded_hex

DICT_BYTES = 1 << 17
DOCS_PER_LANG = 256
DOC_BYTES = 4096
#: Up to so many languages have dictionaries of full size; those of more share the same bytes, down to LEAST_BYTES and LEAST_DOCS each.
WHOLE_LANGS = 256
LEAST_BYTES, LEAST_DOCS = 1024, 4
#: A draw of more than so many times its size has ids that many rows share.
CROWDED = 4
BLOCK_BYTES = 4096
LEAST_MARGIN = 0.01
SEED = 2
LEVEL, MIN_MATCH = 4, 3
_SPACES = b" " * 64
_ASCII_LETTERS_ONLY = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """The text lower-cased, ASCII other than letters dropped, single spaces between words; no letter: empty."""
    out = b" ".join(text.lower().encode("utf-8", "replace").translate(_ASCII_LETTERS_ONLY).split())
    return out if not out or out.isascii() or any(c.isalpha() for c in text) else b""


def learn(docs: DataFrame, dict_bytes: int = DICT_BYTES, docs_per_lang: int = DOCS_PER_LANG) -> dict[str, bytes]:
    """Dictionary content per language, the most frequent first; the driver gets about ``docs_per_lang`` texts of about ``DOC_BYTES`` a language."""
    rows = (docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
            .where(fold_of("doc_id", 4) != 2).withColumn("o", seeded_hex(SEED, "doc_id")))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return {}
    if len(counts) > WHOLE_LANGS:
        dict_bytes = min(dict_bytes, max(LEAST_BYTES, dict_bytes * WHOLE_LANGS // len(counts)))
        docs_per_lang = min(docs_per_lang, max(LEAST_DOCS, docs_per_lang * WHOLE_LANGS // len(counts)))
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, docs_per_lang / r["count"])) for r in counts], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(hex_int(F.col("o"), 1, 8) < F.lit(2.0**32) * F.col("share"))
    # An id that many rows share is drawn with all of them: where a language has far more than its draw, rows are drawn by their texts too.
    crowded = [(r["lang"], docs_per_lang / r["count"]) for r in drawn.groupBy("lang").count().collect() if r["count"] > CROWDED * docs_per_lang]
    if crowded:
        again = F.broadcast(spark.createDataFrame(crowded, "lang string, again double"))
        by_text = hex_int(seeded_hex(SEED, "doc_id", F.md5(F.col("text").cast("binary"))), 1, 8)
        drawn = drawn.join(again, "lang", "left").where(by_text < F.lit(2.0**32) * F.coalesce("again", F.lit(1.0)))
    out = _content(drawn.select("lang", "o", _slice().alias("text")).distinct().collect(), dict_bytes)
    missed = [(r["lang"],) for r in counts if not out.get(r["lang"])]
    if missed:
        some = rows.join(F.broadcast(spark.createDataFrame(missed, "lang string")), "lang").withColumn("text", _slice(at_letter=True))
        first = some.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.min(F.struct("o", "text")).alias("r")).select("lang", "r.*")
        out |= _content(first.collect(), dict_bytes)
    return {r["lang"]: bytes(out[r["lang"]][:dict_bytes]) for r in counts if out.get(r["lang"])}


def _slice(at_letter: bool = False) -> Column:
    """``text``, of a long one about ``DOC_BYTES`` from a place drawn by the hash ``o`` (or from its first letter)."""
    n = F.char_length("text")
    chars = F.greatest(F.lit(1), F.floor(F.lit(float(DOC_BYTES)) * n / F.octet_length("text"))).cast("int")
    start = F.char_length(F.regexp_extract("text", r"^[^\p{L}]*+", 0)) if at_letter else F.pmod(hex_int(F.col("o"), 9, 8), n - chars + 1).cast("int")
    return F.when(F.octet_length("text") <= DOC_BYTES, F.col("text")).otherwise(F.substring(F.col("text"), start + 1, chars))


def _content(picked: list[Row], dict_bytes: int) -> dict[str, bytearray]:
    """Per language the texts in the order of ``o`` up to about ``dict_bytes``; repetitive ones where there are no others."""
    varied: dict[str, bytearray] = {}
    repeated: dict[str, bytearray] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["o"], r["text"])):
        text = normal(r["text"])
        into = varied if len(zlib.compress(text)) >= 0.3 * len(text) else repeated
        have = into.setdefault(r["lang"], bytearray())
        if text and len(have) < dict_bytes:
            have += text + b" "
    return repeated | {lang: have for lang, have in varied.items() if have or lang not in repeated}


def predictor(dictionaries: dict[str, bytes], block_bytes: int = BLOCK_BYTES, least_margin: float = LEAST_MARGIN):
    """A function from text to (lang, score, accepted, margin)."""
    coders = []
    for lang in dictionaries:
        content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=block_bytes, dict_size=len(dictionaries[lang]),
                                                                min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
        content.precompute_compress(compression_params=params)
        coders.append((lang, zstandard.ZstdCompressor(dict_data=content, compression_params=params)))

    def predict(text: str | None) -> tuple[str, float, bool, float]:
        data = normal(text) if text else b""
        if not data or not coders:
            return "und", 0.0, False, 0.0
        blocks = [data[i:i + block_bytes] for i in range(0, len(data), block_bytes)]
        sizes = sorted((sum(len(c.compress(b + _SPACES)) for b in blocks), k, lang) for k, (lang, c) in enumerate(coders))
        best, _, lang = sizes[0]
        score = 1.0 / sum(math.exp(-min(700.0, (s - best) / best / 0.02)) for s, _, _ in sizes)
        margin = (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0
        return lang, score, margin >= least_margin, margin
    return predict


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes], block_bytes: int = BLOCK_BYTES, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """Every row of ``docs`` with lang_pred, score, accepted and margin."""
    rows = docs.drop("lang_pred", "score", "accepted", "margin")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(dictionaries, block_bytes, least_margin)
        for batch in batches:
            got = [predict(t.as_py()) for t in batch.column("text")]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], [*names, "lang_pred", "score", "accepted", "margin"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "lang_pred string, score double, accepted boolean, margin double"])
    return rows.mapInArrow(run, schema)
