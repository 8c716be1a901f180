"""WARC archives: a deduplicating writer and a reader that salvages damaged files.

Writer. Every page becomes one record in its own gzip member. Pages whose payload (UTF-8, at least
``min_bytes``) occurs more than once are decided on digests alone: the smallest id is the response, the others are
revisits that refer to it and carry no payload. Archives are written by Spark's file writer under the folder given,
one per partition, so any file system that Spark writes to will do and a lost task is written again.

Reader. An archive is read member by member (or, where it is not compressed, record by record). Each record is checked:
member checksum, version line, header block, content length, closing line feeds, payload digest. After a failed check
the reader looks for the next place where a whole valid member or version line begins, goes on from there, and logs the
bytes in between as a quarantined gap with its offsets and reason. The same goes for the records inside a member, also
for what came out of one before it was cut off or did not inflate.

Defined cases: a null payload is empty; payloads below ``min_bytes`` are always responses; a null id is kept as null and
comes after all others; rows that repeat the smallest id with the same payload are all responses; a null url becomes
a page URN; line breaks in urls are percent-encoded; empty tables write no record and read as none.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import LAST_ID, saved, small_batches
from retentio.session import ensure_checkpoint_dir

MIN_BYTES = 100
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
GZIP = b"\x1f\x8b\x08"
CHUNK = 1 << 16
# A member without content: what Spark's writer puts between two records, as a valid part of the archive.
NOTHING = gzip.compress(b"", mtime=0)

ENTRY = ("archive string, kind string, start long, stop long, reason string, record_id string, record_type string, "
         "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")


# ---------------------------------------------------------------- records

def record(record_id: str, kind: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head (with the payload's length) and leaves out the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        *([("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)] if refers_to else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", block, b"", b""])


class Damaged(ValueError):
    """A check that a record or member does not pass."""


@dataclass
class Entry:
    """A record, or (``kind`` gap) the bytes ``start`` to ``stop`` that hold no valid one; ``inner`` is where the gap lies
    in the content of the member at ``start``, if that holds valid records too."""

    kind: str
    start: int
    stop: int
    reason: str | None = None
    fields: dict[str, str] | None = None
    payload: bytes = b""
    payload_bytes: int | None = None
    inner: tuple[int, int] | None = None


def parse_record(data: bytes, at: int, ends_with_data: bool) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record at ``at``."""
    if not data.startswith(b"WARC/1.", at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header block does not end")
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    begin = stop + 4
    end = begin + int(length)
    if data[end:end + 4] != b"\r\n\r\n" or ends_with_data and end + 4 != len(data):
        raise Damaged("content length does not meet the record's end")
    return fields, data[begin:end], end + 4


def checked(fields: dict[str, str], block: bytes, start: int, stop: int) -> Entry:
    """The record's payload, held against its digest and length where it is there."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not fields.get("content-type", "").startswith("application/http"):
        payload, size = block, len(block)
    else:
        stated = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(stated[0]) if stated and stated[0].isdigit() else len(payload)
    if fields.get("warc-type") != "revisit":
        digest = fields.get("warc-payload-digest", "")
        if size != len(payload):
            raise Damaged("payload is not as long as stated")
        if digest.startswith("sha256:") and digest[7:].lower() != hashlib.sha256(payload).hexdigest():
            raise Damaged("payload digest differs")
    return Entry("record", start, stop, None, fields, payload, size)


def inflate(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at ``at``, where it ends, and what is wrong with it; then the content is what came
    out before the error."""
    machine, out, pos, step = zlib.decompressobj(31), [], at, CHUNK
    while not machine.eof:
        if pos >= len(data):
            return b"".join(out), pos, "member is cut off"
        try:
            out.append(machine.decompress(data[pos:pos + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), pos, "member checksum differs" if "check" in str(e) else "member does not inflate"
            # Up to here once more, and then byte by byte to the error.
            machine, step = zlib.decompressobj(31), 1
            out = [machine.decompress(data[k:min(k + CHUNK, pos)]) for k in range(at, pos, CHUNK)]
            continue
        pos = min(pos + step, len(data))
    return b"".join(out), pos - len(machine.unused_data), ""


def proved(fields: dict[str, str], payload: bytes) -> bool:
    """Whether the record states a payload digest that can be checked (:func:`checked` has then done so)."""
    return fields.get("warc-type") != "revisit" and fields.get("warc-payload-digest", "").startswith("sha256:")


def member_entries(content: bytes, at: int, stop: int, wrong: str) -> list[Entry]:
    """The valid records of a member's content, and a gap for each run of it that holds none. Where the content may be
    damaged unnoticed, that is, in a member with an error other than its being cut off, only records with a digest count."""
    found, pos, bad, reason = [], 0, -1, ""

    def gap(end: int) -> Entry:
        return Entry("gap", at, stop, f"{reason} (content {bad} to {end})", inner=(bad, end))

    while pos < len(content):
        try:
            fields, block, end = parse_record(content, pos, False)
            entry = checked(fields, block, at, stop)
            if wrong not in ("", "member is cut off") and not proved(fields, entry.payload):
                raise Damaged(f"{wrong} and the record has no digest")
        except Damaged as e:
            if bad < 0:
                bad, reason = pos, str(e)
            pos = content.find(b"WARC/1.", pos + 1)
            if pos < 0:
                break
            continue
        if bad >= 0:
            found.append(gap(pos))
            bad = -1
        found.append(entry)
        pos = end
    if bad >= 0:
        found.append(gap(len(content)))
    return found


def entries_at(data: bytes, view: memoryview, at: int) -> tuple[list[Entry], int, str]:
    """The records that begin at ``at`` (of one member, or one record of plain text), the end of it all, and what is
    wrong with the member if its end is not known."""
    if data.startswith(GZIP, at):
        content, stop, wrong = inflate(view, at)
        found = member_entries(content, at, stop, wrong)
        gaps = [e for e in found if e.kind == "gap"]
        # A member that holds nothing valid is a gap as a whole; so is one whose damage lies anywhere.
        if gaps and len(gaps) == len(found):
            raise Damaged(wrong or gaps[0].reason)
        if wrong and (not found or wrong == "member checksum differs" and not gaps):
            raise Damaged(wrong)
        return found, stop, wrong
    fields, block, stop = parse_record(data, at, False)
    return [checked(fields, block, at, stop)], stop, ""


def salvage(data: bytes) -> Iterator[Entry]:
    """All valid records of an archive in order, and a gap for each run of bytes that holds none."""
    view, pos, bad, reason = memoryview(data), 0, -1, ""
    while pos < len(data):
        try:
            found, stop, wrong = entries_at(data, view, pos)
        except Damaged as e:
            if bad < 0:
                bad, reason = pos, str(e)
            marks = [x for x in (data.find(GZIP, pos + 1), data.find(b"WARC/1.", pos + 1)) if x >= 0]
            pos = min(marks, default=len(data))
            continue
        if bad >= 0:
            yield Entry("gap", bad, pos, reason)
            bad = -1
        yield from found
        if wrong:  # where the member ends is not known; the next one may begin before the error showed
            bad, reason = pos, f"{wrong}, records of it were read"
            marks = [x for x in (data.find(GZIP, pos + 1), data.find(b"WARC/1.", stop)) if x >= 0]
            stop = min(marks, default=len(data))
        pos = stop
    if bad >= 0:
        yield Entry("gap", bad, len(data), reason)


# ---------------------------------------------------------------- Spark jobs

def urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None or page_id == LAST_ID else page_id}"


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``(_id, _digest, first_id)`` of the pages that repeat an earlier payload. Only digests move; a payload
    that a third of the pages share is counted on the map side and its join is split by adaptive execution."""
    thin = saved(pages.where(F.octet_length("_data") >= min_bytes).select("_id", "_digest"))
    first = thin.groupBy("_digest").agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))
    first = saved(first.where("first_id < last_id").select("_digest", "first_id"))
    return saved(thin.join(first, "_digest").where("_id > first_id").select("_id", "_digest", "first_id").distinct())


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write one record per row of ``pages`` into archives under ``path``."""
    small_batches(pages.sparkSession)
    data = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"), F.col(url_col).alias("_url"),
                        data.alias("_data"), F.unhex(F.sha2(data, 256)).alias("_digest"))
    rows = rows.join(revisits(rows, min_bytes), ["_id", "_digest"], "left")

    def members(batches):
        for batch in batches:
            out = []
            for page, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else urn(page)
                kind = "response" if first is None else "revisit"
                out.append(gzip.compress(record(urn(page), kind, uri, payload, None if first is None else urn(first)), 1, mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    packed = rows.select("_id", "_url", "_data", "first_id").mapInArrow(members, "member binary")
    # The writer puts the separator after each record as bytes of this encoding; the members pass as they are.
    separator = {"lineSep": NOTHING.decode("latin-1"), "encoding": "ISO-8859-1"}
    packed.select(F.col("member").cast("string").alias("value")).write.options(**separator).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record or gap of all archives under ``path`` (schema ``ENTRY``)."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                held = 0
                for e in salvage(data.as_buffer().to_pybytes()):
                    f = e.fields or {}
                    bare = lambda k: f[k].strip("<>") if k in f else None
                    rows.append((name, e.kind, e.start, e.stop, e.reason, bare("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"),
                                 bare("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, e.payload_bytes, e.payload))
                    held += len(e.payload)
                    if held > 1 << 24:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ENTRY)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def page_of(c: str) -> Column:
    return F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages, read the archives back, and return what the records say of each page."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/retentio-warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, payload_col, min_bytes)
    return read_archives(spark, path).where("kind = 'record'").select(
        page_of("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to").alias("refers_to"), "target_uri", "payload")
