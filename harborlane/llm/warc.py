"""WARC archives: writing with revisit records, and a reader that salvages damaged archives.

``write_archives`` makes one record per page, each a gzip member of its own. Of the pages with one
payload of at least ``min_revisit`` bytes, the one with the largest id is written as a response, the
others as revisits of it, which hold the HTTP header only. Payloads meet the ids of their responses in
a join on their hash; those of the largest groups of copies, at most ``COMMON``, are sent to all tasks,
so no group meets in one. Archives are written by Spark's text sink, with an empty gzip member in the
place of the line end, so any file system will do; an archive has about ``archive_bytes`` bytes, or one
record that is larger.

``read_archives`` reads compressed and plain archives, with any number of records in a gzip member. A
record counts if its version line, header and length are right, and its digests fit. After a failed
check the reader looks for the next member or version line from where a whole record can be read, goes
on there, and reports the bytes between as a gap with the first reason; within a member it looks in the
decompressed bytes. Of a member that is cut short or damaged, the records before the damage count; if
its bytes or check sum are wrong, only those with a digest that shows them to be right. What such a
member held after the damage cannot be decompressed.

Null html is an empty payload; a null url leaves its field out; control characters in a url are
percent-encoded. A page without an id never is the response of others; if none of the pages with a
payload has an id, all are responses. Rows that repeat the largest id are all responses. No pages give no archives. Other columns are not
looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harborlane.llm.common import stored

MIN_REVISIT = 1000
ARCHIVE_BYTES, BUNDLE_BYTES = 1 << 25, 1 << 19
#: A payload that this part of all pages has is common; there are no more of them than this.
COMMON = 1000
DATE = "2024-01-01T00:00:00Z"
RECORD_ID = "urn:harborlane:page:"
#: A gzip member of no bytes, as text in ISO-8859-1.
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

FOUND = (
    "archive string, offset bigint, size bigint, inner bigint, inner_size bigint, gap string, "
    "record_id string, record_type string, refers_to string, target_uri string, payload_bytes bigint, payload_digest string, payload binary"
)


def base32_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A record; ``refers_to`` is the id of the page whose payload it repeats, else null."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>")
    lines.append(f"WARC-Date: {DATE}")
    if url is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {clean}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: {base32_digest(payload)}",
        f"WARC-Block-Digest: {base32_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + END + block + END


def with_response(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, refers_to) of ``page_id``, ``url`` and ``html``.

    Payloads that are too short to be shared each have a key of their own, so the common short ones
    do not meet in one task.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "payload").cast("string"))
    key = F.when(F.octet_length("payload") >= min_revisit, F.sha2("payload", 256)).otherwise(alone)
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("key", key)
    shared = stored(
        rows.where(F.octet_length("payload") >= min_revisit)
        .groupBy("key")
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") > 1),
        "warc-shared",
    )
    copies = shared.agg(F.sum("pages")).first()[0] or 0
    # Each has so many of the pages that there are at most COMMON of them.
    common = shared.where(F.col("pages") * COMMON >= copies)
    rare = shared.where(F.col("pages") * COMMON < copies)
    placed = rows.join(
        F.broadcast(common.select("key", F.col("holder").alias("_holder"), F.lit(True).alias("_found"))),
        "key", "left",
    ).withColumn("key", F.when(F.col("_found"), alone).otherwise(F.col("key")))
    holder = F.coalesce("_holder", "holder")
    refers_to = F.when(~holder.eqNullSafe(F.col("page_id")), holder)
    return placed.join(rare.select("key", "holder").hint("merge"), "key", "left").select(
        "page_id", "url", "payload", refers_to.alias("refers_to")
    )


def write_archives(
    pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write ``page_id``, ``url``, ``html`` as archives into a new folder."""
    bundle = min(BUNDLE_BYTES, archive_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members, about as many to a row as make a bundle."""
        held, size = [], 0
        for batch in batches:
            for first in range(0, len(batch), 64):
                for r in batch.slice(first, 64).to_pylist():
                    made = record(r["page_id"], r["url"], r["payload"], r["refers_to"])
                    held.append(gzip.compress(made, 6, mtime=0))
                    size += len(held[-1])
                    if size >= bundle:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])

    (
        with_response(pages, min_revisit)
        .mapInArrow(run, "members binary")
        .select(F.col("members").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER)
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", max(1, archive_bytes // bundle))
        .text(folder)
    )


class Damaged(Exception):
    """A check that failed; the text says which."""


def read_member(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at a place, where it ends, and what is wrong with it, if anything.

    What came out before an error is the content then, and the bytes it came from end there.
    """
    tool, parts, end = zlib.decompressobj(31), [], at
    while not tool.eof:
        piece = data[end : end + 65536]
        if not len(piece):
            return b"".join(parts), end, "member cut short"
        try:
            parts.append(tool.decompress(piece))
        except zlib.error:
            tool = zlib.decompressobj(31)
            tool.decompress(data[at:end])
            # The place of the error is found by halves.
            while len(piece):
                half, before = (len(piece) + 1) // 2, tool.copy()
                try:
                    parts.append(tool.decompress(piece[:half]))
                    piece, end = piece[half:], end + half
                except zlib.error:
                    tool, piece = before, piece[: half if half < len(piece) else 0]
            return b"".join(parts), end, "damaged member"
        end += len(piece)
    return b"".join(parts), end - len(tool.unused_data), None


def read_record(data: bytes, at: int, sure: bool = False) -> tuple[dict, int]:
    """The fields and content of the plain record at a place, and where it ends.

    With ``sure``, it needs a digest that can be checked.
    """
    if not re.match(rb"WARC/1\.\d\r\n", data[at : at + 10]):
        raise Damaged("no version line")
    head_end = data.find(END, at)
    if head_end < 0:
        raise Damaged("header cut short")
    fields = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no length")
    begin = head_end + len(END)
    end = begin + int(length)
    if data[end : end + len(END)] != END:
        raise Damaged("wrong length")
    block = data[begin:end]
    if _digest_differs(fields.get("warc-block-digest"), block):
        raise Damaged("block digest")
    http, _, payload = block.partition(END)
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    revisit = fields.get("warc-type") == "revisit"
    if not revisit and _digest_differs(fields.get("warc-payload-digest"), payload):
        raise Damaged("payload digest")
    names = ["warc-block-digest"] if revisit else ["warc-block-digest", "warc-payload-digest"]
    if sure and not any(fields.get(name, "").lower().startswith("sha1:") for name in names):
        raise Damaged("damaged member, no digest")
    found = {
        "record_id": fields.get("warc-record-id", "").strip("<>") or None,
        "record_type": fields.get("warc-type"),
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": int(size[1]) if revisit and size else len(payload),
        "payload_digest": _hexadecimal(fields.get("warc-payload-digest"), payload),
        "payload": None if revisit else payload,
    }
    return found, end + len(END)


def _digest_differs(field: str | None, data: bytes) -> bool:
    """Only SHA-1 in base 32 or 16 can be checked."""
    if not field or not field.lower().startswith("sha1:"):
        return False
    value = field[5:].strip()
    right = hashlib.sha1(data)
    return value.upper() != base64.b32encode(right.digest()).decode() and (
        value.lower() != right.hexdigest()
    )


def _hexadecimal(field: str | None, payload: bytes) -> str:
    if field and field.lower().startswith("sha1:"):
        value = field[5:].strip()
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()
    return hashlib.sha1(payload).hexdigest()


def read_records(content: bytes, sure: bool = False) -> Iterator[tuple[int, int, dict | str]]:
    """(begin, end, record or reason of a gap) of a member's content, in order."""
    at, gap = 0, None
    while at < len(content):
        try:
            found, end = read_record(content, at, sure)
        except Damaged as error:
            gap = gap or (at, str(error))
            start = content.find(VERSION, at + 1)
            at = start if start >= 0 else len(content)
            continue
        if gap:
            yield gap[0], at, gap[1]
            gap = None
        yield at, end, found
        at = end
    if gap:
        yield gap[0], at, gap[1]


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive, and its gaps as rows with ``gap`` set, in the order of the file."""
    view, at, gap = memoryview(data), 0, None
    # Records of a damaged member, which may also be found plain in its bytes.
    kept, kept_until = set(), 0

    def gap_row(end: int) -> dict:
        offset, reason, inner = gap
        return {
            "offset": offset, "size": end - offset, "inner": inner, "inner_size": None, "gap": reason
        }

    while at < len(data):
        wrong, rows = None, []
        if data[at : at + 3] == MEMBER:
            content, end, wrong = read_member(view, at)
            rows = list(read_records(content, wrong == "damaged member"))
            if rows and not any(isinstance(found, dict) for _, _, found in rows):
                if wrong is None:
                    # A whole member without a record.
                    gap, at = gap or (at, rows[0][2], None), end
                    continue
                rows = []
        else:
            try:
                found, end = read_record(data, at)
                if at < kept_until and (found["record_id"], found["payload_digest"]) in kept:
                    at = end
                    continue
                rows = [(None, None, found)]
            except Damaged as error:
                wrong = str(error)
        if rows and gap:
            yield gap_row(at)
            gap = None
        rest = 0
        if rows and wrong:
            kept = {(r["record_id"], r["payload_digest"]) for *_, r in rows if isinstance(r, dict)}
            kept_until = end
            # A record that the damage cut is part of the gap that follows.
            rest = max(e for _, e, r in rows if isinstance(r, dict))
            rows = [row for row in rows if row[1] <= rest]
        for begin, until, found in rows:
            place = {"offset": at, "size": end - at, "inner": begin}
            place["inner_size"] = None if begin is None else until - begin
            if isinstance(found, dict):
                yield {**place, "gap": None, **found}
            else:
                yield {**place, "gap": found}
        if wrong:
            gap = gap or (at, wrong, rest or None)
            starts = [data.find(mark, at + 1) for mark in (MEMBER, VERSION)]
            at = min((s for s in starts if s >= 0), default=len(data))
        else:
            at = end
    if gap:
        yield gap_row(len(data))


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records and gaps of the archives in a folder; without the ``payload`` if it is not asked for.

    A row is a record (``gap`` null) or a gap (``gap`` says which check failed first); ``offset`` and
    ``size`` say where it, or its gzip member, is in the archive, ``inner`` and ``inner_size`` where it
    is in the content of its member. An archive is read by one task, up to 2 GB.
    """
    schema = pa.schema(
        [
            ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64()),
            ("inner", pa.int64()), ("inner_size", pa.int64()), ("gap", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
            ("refers_to", pa.string()), ("target_uri", pa.string()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for row in salvage(content.as_py()):
                    if not payload:
                        row.pop("payload", None)
                    rows.append({"archive": path.as_py(), **row})
                    held += len(row.get("payload") or b"")
                    if held > 1 << 22 or len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    found = spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, FOUND)
    return found if payload else found.drop("payload")


def page_of(record_id):
    """The page id in a record id made by ``record``; null for others."""
    digits = F.regexp_extract(record_id, f"^{RECORD_ID}(-?[0-9]+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))
