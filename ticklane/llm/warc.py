"""WARC derivatives: each response record gives a metadata and a plain-text conversion record that refer to it.

A record is a row: type, id, its headers in order (array of name, value) and its block.  ``responses`` makes records of a
table of pages, ``derive`` makes the linked records, ``write_warc`` and ``read_warc`` go to and from WARC files.  Source
headers (date, target, address, warcinfo id) are carried over, the source's payload digest is kept beside the new block's
own digests, and ids are name-based UUIDs, so reruns give the same files.

Defined cases: a null or empty html is a response with an empty payload, whose conversion is empty; a null url leaves
WARC-Target-URI out; unclosed tags, comments and scripts end with the text; equal rows give equal records (and ids); an
empty table gives no records; other columns are not read; records that are no responses derive nothing.  A chunked body is put together
and a gzip or deflate one unpacked, as far as they are whole; one in another encoding, and one whose type is no text, gets a metadata
record alone; HTML (also without a type) is stripped of its tags, other text stays as it is; an unknown or unusable charset counts as
UTF-8, and bytes that do not fit a charset are replaced.

``read_warc`` takes plain and gzip files, a member a record or all in one.  Blocks are bytes and stay as they are.  Header lines
are UTF-8, or Latin-1 where they are not; names match whatever their case.  A record that the file's end cuts off is returned
with what is there and a header ``WARC-Truncated: unspecified``, also where a gzip member is cut or damaged; a record without
a Content-Length reaches to the next record or the end; one without an id gets a name-based one, one without a type the type
``unknown``; bytes between records are skipped; an empty file has no records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.llm.shared import map_batches

DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
CARRIED = ("WARC-Date", "WARC-Target-URI", "WARC-IP-Address", "WARC-Warcinfo-ID")
SCHEMA = "key {key}, record_type string, record_id string, headers array<struct<name:string,value:string>>, block binary"

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_LINK = re.compile(r"<(?:a|link)\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
# Elements that stand on lines of their own.
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '|'.join(names))}>"


def plain_text(page: str) -> str:
    """Visible text of a page: block elements end lines, white space is single, entities are resolved."""
    page = _DROP.sub("", page)
    page = _TAG.sub(lambda m: "\n" if (m[2] or "").lower() in BLOCKS else "", page)
    lines = (" ".join(x.split()) for x in entities.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


def response(key, url: str | None, page: str | None, date: str = DATE) -> dict:
    """A response record of a page."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    own = record_id("response", str(key), url or "", digest(payload))
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\r\n]", "", url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return {"key": key, "record_type": "response", "record_id": own, "headers": [{"name": n, "value": v} for n, v in headers], "block": block}


def _linked(source: dict, kind: str, content_type: str, block: bytes) -> dict:
    had = {h["name"].lower(): h["value"] for h in source["headers"]}
    own = record_id(kind, source["record_id"])
    headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source["record_id"])]
    headers += [(n, had[n.lower()]) for n in CARRIED if n.lower() in had]
    if "warc-payload-digest" in had:
        headers.append(("WARC-Refers-To-Payload-Digest", had["warc-payload-digest"]))
    headers += [("Content-Type", content_type), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return {"key": source["key"], "record_type": kind, "record_id": own, "headers": [{"name": n, "value": v} for n, v in headers], "block": block}


def field_of(fields: list[str], name: str) -> str:
    """The value of an HTTP header (the last one of that name), in lower case; empty without it."""
    return next((v.strip().lower() for f in reversed(fields) for n, _, v in [f.partition(":")] if n.strip().lower() == name), "")


def unchunked(body: bytes) -> bytes:
    """A chunked body put together; where it breaks off, or is not chunked, with what is there."""
    parts, at = [], 0
    while 0 <= (end := body.find(b"\n", at)):
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,12}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(parts)
        parts.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0
    return b"".join(parts) if parts else body


def inflated(body: bytes, encoding: str) -> bytes | None:
    """A gzip or deflate body unpacked, as far as it is whole; as it is if it is not packed; None for an encoding that is not known here."""
    for name in reversed([x.strip() for x in encoding.split(",")]):
        if name in ("", "identity"):
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            return None
        for bits in (47, -15):
            member, out = zlib.decompressobj(bits), []
            try:
                for low in range(0, len(body), 1 << 16):
                    out.append(member.decompress(body[low : low + (1 << 16)]))
            except zlib.error:
                pass
            if any(out):
                body = b"".join(out)
                break
    return body


def decoded(payload: bytes, charset: str) -> str:
    try:
        return payload.decode(charset, "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def derivatives(source: dict) -> list[dict]:
    """The metadata record of a response record and, if its body is text, the conversion record."""
    head, _, payload = source["block"].partition(b"\r\n\r\n")
    fields = head.decode("latin-1").split("\r\n")
    charset = next((m[1] for f in fields if (m := re.search(r"(?i)^content-type:.*charset=\"?([\w-]+)", f))), "utf-8")
    kind = field_of(fields, "content-type").split(";")[0].strip()
    body = inflated(unchunked(payload) if "chunked" in field_of(fields, "transfer-encoding") else payload, field_of(fields, "content-encoding"))
    markup = kind in ("", "text/html", "application/xhtml+xml")
    if body is None or not (markup or kind.startswith("text/")):
        said = f"http-status: {fields[0].split(' ')[1] if ' ' in fields[0] else ''}\r\ncontent-type: {kind}\r\npayload-length: {len(payload)}\r\n"
        return [_linked(source, "metadata", "application/warc-fields", said.encode("utf-8", "surrogatepass"))]
    page = decoded(body, charset)
    bare = _DROP.sub("", page) if markup else ""
    text = plain_text(page) if markup else page
    title = _TITLE.search(bare)
    language = _LANG.search(bare)
    links = [entities.unescape(next(x for x in m.groups() if x is not None)) for m in _LINK.finditer(bare)]
    lines = [f"http-status: {fields[0].split(' ')[1] if ' ' in fields[0] else ''}", f"charset: {charset}", f"payload-length: {len(payload)}", f"text-length: {len(text)}"]
    lines += [f"title: {' '.join(entities.unescape(title[1]).split())}"] if title else []
    lines += [f"language: {language[1]}"] if language else []
    lines += [f"outlink: {' '.join(x.split())}" for x in links]
    said = "".join(f"{x}\r\n" for x in lines).encode("utf-8", "surrogatepass")
    return [_linked(source, "metadata", "application/warc-fields", said), _linked(source, "conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass"))]


def _records(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("key", kind), ("record_type", pa.string()), ("record_id", pa.string()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())])


def responses(pages: DataFrame, date: str = DATE, key: str = "page_id") -> DataFrame:
    """Response records of pages (page_id, url, html)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            yield pa.RecordBatch.from_pylist([response(*row, date) for row in rows], schema=_records(batch.column(0).type))

    return map_batches(pages.select(key, "url", "html"), made, SCHEMA.format(key=pages.schema[key].dataType.simpleString()))


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256).to_pylist()
                yield pa.RecordBatch.from_pylist([d for r in rows for d in derivatives(r)], schema=_records(batch.column(0).type))

    return map_batches(records.where(F.col("record_type") == "response"), made, SCHEMA.format(key=records.schema["key"].dataType.simpleString()))


def header(name: str):
    """The value of a header of a record."""
    return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def write_warc(records: DataFrame, path: str) -> None:
    """WARC 1.0 files, one a partition. Blocks of any bytes pass as they are: a string column is only a name for them here."""
    head = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    block = F.coalesce(F.col("block"), F.lit(b"")).cast("string")
    records.select(F.concat(F.lit("WARC/1.0\r\n"), head, F.lit("\r\n"), block, F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").text(path)


def unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of the bytes of a file, whose gzip members, if it has any, are unpacked; what cannot be unpacked ends it."""
    if data[:2] != b"\x1f\x8b":
        for low in range(0, len(data), step):
            yield data[low : low + step]
        return
    rest, at = memoryview(data), 0
    while at < len(rest):
        member = zlib.decompressobj(31)
        try:
            while at < len(rest) and not member.eof:
                piece = rest[at : at + step]
                at += len(piece)
                out = member.decompress(piece)
                at -= len(member.unused_data)
                yield out
        except zlib.error:
            return
        while at < len(rest) and rest[at] == 0:  # padding between members
            at += 1


def _said(line: bytes) -> dict:
    try:
        text = line.decode("utf-8")
    except UnicodeDecodeError:
        text = line.decode("latin-1")
    name, _, value = text.partition(":")
    return {"name": name.strip(), "value": value.strip()}


def parse(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of the bytes of a WARC file, which come in pieces; one record and a piece are held at a time, and no byte is moved twice
    but for those of the piece in which a record begins."""
    held, at, more = b"", 0, iter(pieces)

    def grow(least: int = 1) -> bool:
        """At least so many bytes more, if there are any; what lies before ``at`` goes."""
        nonlocal held, at
        parts, length = [held[at:]], 0
        while length < least and (piece := next(more, None)) is not None:
            parts.append(piece)
            length += len(piece)
        held, at = b"".join(parts), 0
        return length > 0

    def found(what: bytes, low: int = 0) -> int:
        """Where it is, from ``at`` on; -1 if it never comes."""
        while (k := held.find(what, at + low)) < 0:
            low = max(low, len(held) - at - len(what) + 1)
            if not grow(max(1, len(held) - at)):  # twice as much each time
                return -1
        return k - at

    while (start := found(b"WARC/")) >= 0:
        end = found(b"\r\n\r\n", start)
        cut = end < 0
        lines = held[at + start : len(held) if cut else at + end].split(b"\r\n")[1:]
        headers = [_said(x) for x in lines if b":" in x]
        had = {h["name"].lower(): h["value"] for h in headers}
        begin = len(held) - at if cut else end + 4
        size = had.get("content-length", "")
        if cut:
            stop = begin
        elif re.fullmatch(r"[0-9]+", size):
            stop = begin + int(size)
            if len(held) - at < stop:
                grow(stop - (len(held) - at))
            cut = len(held) - at < stop
        else:
            mark = found(b"\r\n\r\nWARC/", begin)
            stop = len(held) - at if mark < 0 else mark
        block = held[at + begin : at + stop]
        if cut:
            headers.append({"name": "WARC-Truncated", "value": "unspecified"})
        own = had.get("warc-record-id") or record_id("unnamed", had.get("warc-type", ""), digest(block))
        yield {"key": own, "record_type": had.get("warc-type", "unknown"), "record_id": own, "headers": headers, "block": block}
        at = min(at + stop, len(held))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, gzip or not; key is the record id. A file of up to 2 GB is read by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for low in _chunks(parse(unpacked(data.as_py())), 256):
                    yield pa.RecordBatch.from_pylist(low, schema=_records(pa.string()))

    return map_batches(spark.read.format("binaryFile").load(path).select("content"), read, SCHEMA.format(key="string"))


def _chunks(items: Iterator[dict], width: int) -> Iterator[list[dict]]:
    some: list[dict] = []
    for x in items:
        some.append(x)
        if len(some) == width:
            yield some
            some = []
    if some:
        yield some
