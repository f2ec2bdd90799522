"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

A record is a row: record_id, type, target_uri, date, content_type, headers map<string, string> and
block binary. Each response gives a metadata record (title, language, link count, the source's status
and HTTP headers) and a conversion record (visible text). Both name the response in WARC-Refers-To and
keep its target and date; the metadata record names the conversion in WARC-Concurrent-To and repeats
the response's own digests. Digests are sha1 in base 32. Record ids are UUIDs made from the content, so
reruns agree.

Defined results: null url and html count as empty; a block that isn't an HTTP message, or whose digest
doesn't hold, gives both records with an empty text and a warc-error field; records that aren't
responses give nothing; equal rows give equal records; other columns are not read. Header names have no
case. What is wrong in a file never ends the job: read_warc gives each record it can tell, with an error
(see parse) where it isn't whole; null headers and blocks are written as none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy

RECORD = "record_id string, type string, target_uri string, date string, content_type string, headers map<string,string>, block binary"
FIELDS = ["record_id", "type", "target_uri", "date", "content_type", "headers", "block"]
NAMES = {"record_id": "warc-record-id", "type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type"}
GZIP = re.compile(rb"\x1f\x8b\x08")
READ_BYTES = 1 << 20
CAPTURED = "2024-01-01T00:00:00Z"
# What nothing closes goes on to the end, and tags hold no "<", so that no page is scanned twice.
DROPPED = re.compile(r"<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
BREAKS = re.compile(r"<(?:/?(?:p|div|ul|ol|li|h[1-6]|tr|table|article|section|nav|header|footer|title|body|head)|br)\b[^<>]*>", re.I)
TAGS = re.compile(r"<[^<>]*>")
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
LINES = re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
LANG = re.compile(r"<html\b[^<>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
LINK = re.compile(r"<a\b[^<>]*?\shref\s*=", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: bytes) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p).to_bytes(8, "big") + p)
    return f"<urn:uuid:{uuid.UUID(bytes=h.digest()[:16], version=5)}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def plain_text(page: str) -> str:
    """Visible text of an HTML page, a line for each block element."""
    text = TAGS.sub("", BREAKS.sub("\n", DROPPED.sub(" ", page)))
    return LINES.sub("\n", BLANKS.sub(" ", entities.unescape(text))).strip()


def http_message(block: bytes) -> tuple[str, list[tuple[str, str]], bytes] | None:
    """Status line, headers in order and payload; None if the block is no HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not gap or not lines[0].startswith("HTTP/"):
        return None
    pairs = [line.partition(":") for line in lines[1:]]
    return lines[0], [(k.strip(), v.strip()) for k, colon, v in pairs if colon], payload


def derivatives(record: dict) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    source, headers, block = record["record_id"] or "", dict(record["headers"] or {}), record["block"] or b""
    named = {k.lower(): v for k, v in headers.items()}
    message = http_message(block)
    error = "" if message else "no HTTP response"
    status, http, payload = message or ("", [], b"")
    if not error and (named.get("warc-payload-digest") or digest(payload)) != digest(payload):
        error = "payload digest differs"
    content = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = CHARSET.search(content)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    html = not error and "html" in content.lower()
    text = "" if error else plain_text(page) if html else page if content.lower().startswith("text/") else ""
    out = text.encode()
    linked = {"WARC-Refers-To": source, "WARC-Refers-To-Target-URI": record["target_uri"] or "", "WARC-Refers-To-Date": record["date"] or ""}
    linked |= {f"WARC-Source-{k}": named[f"warc-{k.lower()}"] for k in ("Payload-Digest", "Block-Digest") if f"warc-{k.lower()}" in named}
    conversion = record_id(b"conversion", source.encode(), out)
    fields = [("refers-to", source), ("title", one_line(entities.unescape(TITLE.search(page)[1])) if html and TITLE.search(page) else ""), ("declared-language", LANG.search(page)[1].lower() if html and LANG.search(page) else ""), ("links", str(len(LINK.findall(page)) if html else 0)), ("text-length", str(len(text))), ("http-status", one_line(status))]
    fields += [("http-header", f"{one_line(k)}: {one_line(v)}") for k, v in http] + ([("warc-error", error)] if error else [])
    info = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    common = {"target_uri": record["target_uri"], "date": record["date"]}
    return [
        common | {"record_id": record_id(b"metadata", source.encode(), info), "type": "metadata", "content_type": "application/warc-fields", "headers": linked | {"WARC-Concurrent-To": conversion, "WARC-Block-Digest": digest(info)}, "block": info},
        common | {"record_id": conversion, "type": "conversion", "content_type": "text/plain; charset=utf-8", "headers": linked | {"WARC-Block-Digest": digest(out), "WARC-Payload-Digest": digest(out)}, "block": out},
    ]


ARROW = pa.schema([(f, pa.string()) for f in FIELDS[:5]] + [("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def _batches(rows: Iterator[dict], extra: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most a few MB; extra are columns of ids before the fields, more texts after them."""
    held, size = [], 0
    kinds = pa.schema([*(pa.field(c, pa.int64()) for c in extra), *ARROW, *(pa.field(c, pa.string()) for c in more)])
    for r in rows:
        held.append(r | {"headers": list((r["headers"] or {}).items())})
        size += len(r["block"])
        if len(held) >= 1000 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=kinds)


def responses(pages: DataFrame, captured: str = CAPTURED) -> DataFrame:
    """A response record, with its page_id, for each row of pages(page_id, url, html)."""

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    page, url, html = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html"))
                    payload = (html or "").encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%s" % (len(payload), payload)
                    headers = {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block)}
                    own = record_id(b"response", str(page).encode(), (url or "").encode(), block)
                    yield {"page_id": page, "record_id": own, "type": "response", "target_uri": url or "", "date": captured, "content_type": "application/http; msgtype=response", "headers": headers, "block": block}

        yield from _batches(rows(), ("page_id",))

    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), f"page_id long, {RECORD}")


def build_derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records; columns named *_id of long type are kept, others are not read."""
    extra = tuple(c for c, kind in records.dtypes if kind == "bigint" and c.endswith("_id") and c not in FIELDS)

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    r = {c: batch.column(c)[i].as_py() for c in (*extra, *FIELDS)}
                    for d in derivatives(r):
                        yield {c: r[c] for c in extra} | d

        yield from _batches(rows(), extra)

    schema = ", ".join([*(f"`{c}` long" for c in extra), RECORD])
    return records.where(F.col("type") == "response").select(*extra, *FIELDS).mapInArrow(tidy(run), schema)


def as_bytes(record: dict) -> bytes:
    """A record in WARC/1.1 form, as one gzip member."""
    block = record["block"] or b""
    head = {"WARC-Type": record["type"], "WARC-Record-ID": record["record_id"], "WARC-Target-URI": record["target_uri"], "WARC-Date": record["date"], **dict(record["headers"] or {}), "Content-Type": record["content_type"], "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {one_line(str(v))}\r\n" for k, v in head.items() if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", mtime=0)


def _next_member(data: memoryview, at: int) -> int:
    """Where, from at on, a gzip member begins whose content begins as a WARC record; the end if nowhere."""
    for found in GZIP.finditer(data, at):
        try:
            if zlib.decompressobj(31).decompress(data[found.start() : found.start() + 4096], 5) == b"WARC/":
                return found.start()
        except zlib.error:
            continue
    return len(data)


def members(data: bytes) -> Iterator[tuple[bytes, str]]:
    """The gzip members of data, decompressed one by one, with an error or ""; data itself if it is plain.

    Of a damaged or cut member what could be read is given, and reading goes on at the next member that
    begins as a record.
    """
    view, at = memoryview(data), 0
    if bytes(view[:2]) != b"\x1f\x8b":
        yield bytes(view), ""  # an Arrow buffer can't be searched
        return
    while at < len(view):
        d, out, error, end = zlib.decompressobj(31), [], "", at
        try:
            while end < len(view) and not d.eof:
                out.append(d.decompress(view[end : end + READ_BYTES]))
                end = min(end + READ_BYTES, len(view))
            if not d.eof:
                error = "gzip member is cut short"
        except zlib.error:
            error = "gzip member is damaged"
        yield b"".join(out), error
        end = at + 1 if error else end - len(d.unused_data)
        at = end if bytes(view[end : end + 2]) == b"\x1f\x8b" and not error else _next_member(view, end)


def _records(part: bytes) -> Iterator[dict]:
    at = 0
    while (at := part.find(b"WARC/1.", at)) >= 0:
        end = part.find(b"\r\n\r\n", at)
        error, start = ("", end + 4) if end >= 0 else ("header is cut short", len(part))
        pairs = [x.partition(":") for x in part[at : start if end < 0 else end].decode("utf-8", "replace").split("\r\n")[1:]]
        head = {k.strip(): v.strip() for k, colon, v in pairs if colon}
        known = {k.lower(): k for k in head}
        take = lambda name: head.pop(known[name], None) if name in known else None
        length = take("content-length")
        if not error and not (length and length.isascii() and length.isdigit()):
            error = "no Content-Length" if length is None else "Content-Length is no number"
        # Without a length the block goes on to the next record.
        following = part.find(b"\r\n\r\nWARC/1.", end) if error and end >= 0 else -1
        size = int(length) if not error else max(0, (following if following >= 0 else len(part)) - start)
        block = part[start : start + size]
        if not error and len(block) < size:
            error = "block is cut short"
        yield {f: take(h) for f, h in NAMES.items()} | {"headers": head, "block": block, "error": error or None}
        at = start + len(block)


def parse(data: bytes) -> Iterator[dict]:
    """The records of WARC bytes, plain or gzip members; of members one at a time is held decompressed.

    A record's error is null, or says that its header or block is cut short, that its Content-Length is missing
    or no number (the block then goes on to the next record), or that its gzip member is damaged or cut; a member
    without any record is an empty record with that error.
    """
    for part, error in members(data):
        last = None
        for r in _records(part):
            if last:
                yield last
            last = r
        if error:
            last = (last or dict.fromkeys(FIELDS) | {"headers": {}, "block": b""}) | {"error": error}
        if last:
            yield last


def read_warc(files: DataFrame) -> DataFrame:
    """Records, with their error, of WARC files read with spark.read.format("binaryFile"): a file's compressed bytes and one member are held at a time."""

    def run(batches):
        yield from _batches((r for b in batches for i in range(b.num_rows) if b.column("content")[i].is_valid for r in parse(b.column("content")[i].as_buffer())), more=("error",))

    return files.select("content").mapInArrow(tidy(run), f"{RECORD}, error string")


def serialized(records: DataFrame) -> DataFrame:
    """records with a column member: the record as a gzip member; files are members one after another."""

    def run(batches):
        for batch in batches:
            members = [as_bytes({c: batch.column(c)[i].as_py() for c in FIELDS}) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("type"), pa.array(members, pa.binary())], names=["record_id", "type", "member"])

    return records.select(*FIELDS).mapInArrow(run, "record_id string, type string, member binary")
