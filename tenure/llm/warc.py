"""Operator 3, WARC archives: a deduplicating writer and a salvaging reader.

``write_archives`` writes a record per row as plain WARC/1.1 files with Spark's text writer (long records go to
files of their own with fewer records, so a file holds ``FILE_BYTES`` at most, or one record): the row holds header and payload, the writer's line separator is the blank line that ends
a record. Payloads equal by SHA-1 are stored once: the row with the smallest id is the ``response``, the others
are ``revisit`` records that refer to it. ``read_archives`` reads files of plain records or of gzip members,
checks version line, headers, length, record end and digest of every record, and after a failed check searches
for the next member or version line that passes them. What lies between is logged as a ``gap`` row with its
offsets and the reason, so every byte of a file is in a record or in a gap.

Defined cases: a null payload is empty; a null id is larger than all ids (a group of null ids only is all
responses); rows that repeat the smallest id are responses too; a null url has no Target-URI line; control
characters and spaces of a url are percent-encoded; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Duplicate digests up to this many rows (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
RECORDS_PER_FILE = 2_000
#: Files hold this many bytes at most, or one longer record: readers take a file whole.
FILE_BYTES = 128 << 20
#: Records are written by length, those up to each of these bounds together, the rest one to a file.
LENGTHS = (64 << 10, 1 << 20, 16 << 20)
_END = "\r\n\r\n"


def base32_sha1(col: Column) -> Column:
    """Upper-case base32 of the SHA-1, from hex: each 5 hex digits are 4 base32 digits."""
    h = F.sha1(col.cast("binary"))
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _prepared(df: DataFrame, id_col: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), body.alias("body"), base32_sha1(body).alias("digest"),
                     F.octet_length(body).cast("long").alias("bytes"))


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE, least_bytes: int = 0,
                   lengths: tuple[int, ...] = LENGTHS, file_bytes: int = FILE_BYTES) -> int:
    """Write every row of ``df`` as a record under ``path`` and return their number; payloads under ``least_bytes`` are never revisits.

    Records are written once per class of ``lengths`` that the table has (counted first, by an upper bound of a record's length).
    """
    rows = _prepared(df, id_col, url, payload)
    groups = (rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
              .where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id").persist())
    try:
        if groups.count() <= BROADCAST_ROWS:  # else the payloads are dealt out by digest
            groups = F.broadcast(groups)
        rows = rows.join(groups, "digest", "left")
        revisit = F.col("first_id").isNotNull() & (F.col("bytes") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
        target = F.col("url")
        for pattern, code in (("\\x09", "%09"), ("\\x0a", "%0A"), ("\\x0d", "%0D"), (" ", "%20"), ("[\\x00-\\x1f\\x7f]", "%00")):
            target = F.regexp_replace(target, pattern, code)
        eol = "\r\n"
        head = F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
            F.lit(f"{eol}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f">{eol}WARC-Date: {date}{eol}"),
            F.coalesce(F.concat(F.lit("WARC-Target-URI: "), target, F.lit(eol)), F.lit("")),
            F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{eol}X-Payload-Length: "), F.col("bytes").cast("string"), F.lit(eol),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"),
                                     F.lit(f">{eol}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{eol}"))).otherwise(""),
            F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")),
            F.lit(_END), F.when(revisit, "").otherwise(F.col("body")))
        # At most this long: a character of the url takes up to three bytes when encoded, the other lines are under 1 KB.
        longest = F.col("bytes") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + 1024
        kind = F.lit(len(lengths))
        for i in reversed(range(len(lengths))):
            kind = F.when(longest <= lengths[i], i).otherwise(kind)
        have = _prepared(df, id_col, url, payload).groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()  # a row per class
        first = True
        for i in sorted(r["kind"] for r in have) or [0]:
            each = min(records_per_file, max(1, file_bytes // lengths[i])) if i < len(lengths) else 1
            (rows.where(kind == i).select(head.alias("value")).write.mode("error" if first else "append")
             .option("lineSep", _END).option("maxRecordsPerFile", each).text(path))
            first = False
        return sum(r["n"] for r in have)
    finally:
        groups.unpersist()


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HEADER_END = re.compile(rb"\r\n\r\n|\r\nWARC/1\.[01]\r\n")


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """The record at ``at`` as headers, payload and end, or what is wrong with it."""
    if not (m := _VERSION.match(data, at)):
        return "no version line"
    stop = _HEADER_END.search(data, m.end() - 2)  # headers of any size, but not into the next record
    if not stop or stop[0] != b"\r\n\r\n":
        return "headers do not end"
    end = stop.start()
    headers = {}
    for line in data[m.end():end].split(b"\r\n") if end > m.end() else []:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "bad length"
    start, stop = end + 4, end + 4 + int(length)
    if data[stop:stop + 4] != b"\r\n\r\n":
        return "record end is not where the length says"
    payload, digest = data[start:stop], headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and digest.lower().startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:].upper():
            return "digest differs"
    return headers, payload, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The gzip member at ``at``, whole, and its end, or what is wrong with it."""
    d, out, pos, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while pos < len(data) and not d.eof:
            piece = view[pos:pos + (1 << 16)]
            out.append(d.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        return f"bad member: {e}"
    return (b"".join(out), pos - len(d.unused_data)) if d.eof else "member does not end"


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None, str | None]]:
    """(start, end, headers, payload, reason) of records (reason None) and gaps (headers None), in file order.

    Offsets are those of the file; records of one gzip member share the member's offsets.
    """
    at, gap, why = 0, None, None
    ahead = {b"WARC/1.": -1, b"\x1f\x8b\x08": -1}  # the last mark found of each kind: the file is searched once for each
    while at < len(data):
        found, end = [], at
        if data[at:at + 2] == b"\x1f\x8b":
            got = _member(data, at)
            if not isinstance(got, str):
                inner, end = got
                found = [(at, end, h, p, r) for _, _, h, p, r in salvage_plain(inner)]
        else:
            got = parse_record(data, at)
            if not isinstance(got, str):
                end = got[2]
                found = [(at, end, got[0], got[1], None)]
        if found:
            if gap is not None:
                yield gap, at, None, None, why
                gap = None
            yield from found
            at = end
            continue
        if gap is None:
            gap, why = at, got if isinstance(got, str) else "empty member"
        for mark, last in ahead.items():
            if last <= at:
                found_at = data.find(mark, at + 1)
                ahead[mark] = found_at if found_at >= 0 else len(data)
        at = min(ahead.values())
    if gap is not None:
        yield gap, len(data), None, None, why


def salvage_plain(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None, str | None]]:
    """``salvage`` inside a gzip member: plain records only."""
    at, gap, why = 0, None, None
    while at < len(data):
        got = parse_record(data, at)
        if isinstance(got, str):
            if gap is None:
                gap, why = at, got
            at = data.find(b"WARC/1.", at + 1)
            at = len(data) if at < 0 else at
            continue
        if gap is not None:
            yield gap, at, None, None, why
            gap = None
        yield at, got[2], got[0], got[1], None
        at = got[2]
    if gap is not None:
        yield gap, len(data), None, None, why


SCHEMA = ("path string, start long, end long, kind string, reason string, record_type string, record_id string, refers_to string, "
          "target_uri string, payload_digest string, payload_bytes long, payload binary")
_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("reason", pa.string()),
                    ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_ROWS = 256


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            for start, end, h, payload, reason in salvage(content.as_py()):
                row = {"path": path, "start": start, "end": end, "kind": "gap" if h is None else "record", "reason": reason}
                if h is not None:
                    length = h.get("x-payload-length", "")
                    row |= {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"),
                            "target_uri": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest", "").rpartition(":")[2] or None,
                            "payload_bytes": int(length) if length.isdigit() else len(payload), "payload": payload}
                rows.append(row)
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record and per gap of every archive under ``path``; a file is read by one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, SCHEMA)


def page_id(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


ORACLE = f"""
WITH h AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, x, {' || '.join(
    f"lpad(to_base(CAST(('0x' || substr(x, {1 + 5 * i}, 5)) AS BIGINT), 32), 4, '0')" for i in range(8))} AS v FROM h),
m AS (SELECT x, min(page_id) AS first_id FROM d GROUP BY x)
SELECT page_id, payload_bytes, translate(v, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id OR first_id IS NULL THEN NULL ELSE first_id END AS refers_to
FROM d JOIN m USING (x)"""
