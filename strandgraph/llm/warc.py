"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

A record is a row (record_id, record_type, target_uri, warc_date, content_type, refers_to, block, block_digest,
payload_digest, source_headers); `serialise` gives its bytes and `parse` reads them."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = (
    "record_id string, record_type string, target_uri string, warc_date string, content_type string, refers_to string, "
    "block binary, block_digest string, payload_digest string, source_headers map<string,string>"
)
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_KINDS = [*[pa.string()] * 6, pa.binary(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
#: Elements without readable text, and what breaks a line.
_MUTE = frozenset("script style template noscript iframe svg".split())
_BREAKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in _MUTE}
_TITLE_END = re.compile(r"</title", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([\w-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str | bytes) -> str:
    """A urn:uuid that depends on the parts alone, so a task that runs again names its records alike."""
    raw = b"\0".join(p.encode() if isinstance(p, str) else p for p in parts)
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(raw).digest()[:16], version=5)}>"


def markup(page: str) -> Iterator[tuple[str, int, int, int]]:
    """(name, start, end, end of the tag) of each piece of markup in order: names of tags in lower case, those that close with a slash before; "!" for comments and declarations.

    An element without readable text is one piece up to where it closes, or to the end of the page. What a `<` opens and no `>`
    closes is text. Every search starts where the last one ended, or is the last, so any page takes linear time."""
    at = page.find("<")
    while at >= 0:
        after = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            end = len(page) if stop < 0 else stop + 3
            yield "!", at, end, end
        elif after in ("!", "?") and after:
            stop = page.find(">", at)
            if stop < 0:
                return
            end = stop + 1
            yield "!", at, end, end
        else:
            slash = after == "/"
            name = _NAME.match(page, at + 1 + slash)
            if not name:
                at = page.find("<", at + 1)
                continue
            stop = page.find(">", name.end())
            if stop < 0:
                return
            kind, tag, end = name[0].lower(), stop + 1, stop + 1
            if kind in _MUTE and not slash:
                close = _CLOSE[kind].search(page, tag)
                end = close.end() if close else len(page)
            yield "/" * slash + kind, at, end, tag
        at = page.find("<", end)


def read_page(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """(text, title, language, links): the readable text without comments, scripts or styles, a line for each block, single spaces; the rest as written."""
    pieces, links, title, lang, at, titled = [], [], None, None, 0, False
    for name, start, end, tag in markup(page):
        pieces.append(page[at:start])
        at = end
        if name in _MUTE:
            pieces.append(" ")
        elif name.removeprefix("/") in _BREAKS:
            pieces.append("\n")
        if name == "a" and (m := _HREF.search(page, start, tag)):
            links.append(m[1] or m[2] or m[3] or "")
        elif name == "html" and lang is None and (m := _LANG.search(page, start, tag)):
            lang = m[1]
        elif name == "title" and not titled:
            titled = True
            if m := _TITLE_END.search(page, end):
                title = page[end : m.start()]
    text = entities.unescape("".join([*pieces, page[at:]]))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x), title, lang, links


def response(page_id: int | None, url: str, page: str, date: str) -> tuple:
    payload = page.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return (record_id("response", str(page_id), url, payload), "response", url, date, "application/http; msgtype=response", None, block, digest(block), digest(payload), None)


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, header fields (names in lower case; of repeated ones, the values joined) and payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            key = name.strip().lower()
            fields[key] = f"{fields[key]}, {value.strip()}" if key in fields else value.strip()
    return status, fields, payload


def derive(rid: str, url: str | None, date: str, block: bytes, payload_digest: str | None) -> Iterator[tuple]:
    """The metadata record of a response, then its conversion, if it is a page."""
    status, fields, payload = split_http(block)
    kind = fields.get("content-type", "")
    charset = m[1] if (m := re.search(r"charset=\"?([\w-]+)", kind, re.I)) else "utf-8"
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source = {"status": status, **fields}
    payload_digest = payload_digest or digest(payload)
    is_page = "html" in kind.lower()
    one = lambda x: " ".join(entities.unescape(x).split())
    notes = [("source-status", status), *((f"source-{k}", v) for k, v in fields.items()), ("source-payload-digest", payload_digest)]
    if is_page:
        plain, title, lang, links = read_page(page)
        text = plain.encode()
        conversion = record_id("conversion", rid)
        notes += [] if title is None else [("title", one(title))]
        notes += [] if lang is None else [("html-lang", lang)]
        notes += [("outlink", one(x)) for x in links]
        notes += [("conversion-record-id", conversion), ("conversion-digest", digest(text))]
    body = "".join(f"{k}: {v}\r\n" for k, v in notes).encode()
    yield (record_id("metadata", rid), "metadata", url, date, "application/warc-fields", rid, body, digest(body), payload_digest, source)
    if is_page:
        yield (conversion, "conversion", url, date, "text/plain; charset=utf-8", rid, text, digest(text), payload_digest, source)


def _batch(rows: list[tuple], extra: list | None = None, name: str = "") -> pa.RecordBatch:
    columns = [pa.array([None if v is None else list(v.items()) if isinstance(v, dict) else v for v in c], k) for c, k in zip(zip(*rows), _KINDS)] if rows else [pa.array([], k) for k in _KINDS]
    return pa.RecordBatch.from_arrays(([pa.array(extra, pa.int64())] if name else []) + columns, ([name] if name else []) + _NAMES)


def _small(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most 256 rows and about `most` bytes in the column; a larger row comes alone."""
    for b in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        k = 0
        while k < b.num_rows:
            stop = max(k + 1, min(k + 256, int(np.searchsorted(size, (size[k - 1] if k else 0) + most, "right"))))
            yield b.slice(k, stop - k)
            k = stop


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record columns): a response record for each row of (page_id, url, html).

    Pages carry no time, so the date is a parameter. A null url or html is empty; a row with a null page_id
    keeps it; repeated rows give the same record again. Other columns are not read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 2):
            ids, urls, pages_ = (c.to_pylist() for c in b.columns)
            yield _batch([response(i, u or "", p or "", date) for i, u, p in zip(ids, urls, pages_)], ids, "page_id")

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(scan, "page_id long, " + RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """(page_id, record columns) of the metadata and conversion records of all response records.

    Each refers to its response, carries that one's target, date and payload digest, and has the source's status
    and header fields in source_headers. A response that isn't a page gets metadata only; other records and null
    blocks or identifiers give nothing."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 4):
            made = [(i, r) for i, *x in zip(*(c.to_pylist() for c in b.columns)) for r in derive(*x)]
            yield _batch([r for _, r in made], [i for i, _ in made], "page_id")

    chosen = records.where("record_type = 'response' AND block IS NOT NULL AND record_id IS NOT NULL")
    return chosen.select("page_id", "record_id", "target_uri", "warc_date", "block", "payload_digest").mapInArrow(scan, "page_id long, " + RECORD)


_HEADERS = {"WARC-Type": 1, "WARC-Record-ID": 0, "WARC-Date": 3, "WARC-Target-URI": 2, "WARC-Refers-To": 5, "Content-Type": 4, "WARC-Block-Digest": 7, "WARC-Payload-Digest": 8}


def serialise(record: tuple) -> bytes:
    """The bytes of one record; write them into a gzip member each for a .warc.gz file. The source's headers stand as WARC-Source-* fields."""
    fields = [(k, record[i]) for k, i in _HEADERS.items() if record[i] is not None]
    fields += [(f"WARC-Source-{k}", v) for k, v in (record[9] or {}).items()]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(record[6]))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + record[6] + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple]:
    """The records of a WARC file's plain bytes."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        out: list = [None] * 10
        for k, i in _HEADERS.items():
            out[i] = fields.get(k)
        out[6] = data[cut + 4 : cut + 4 + size]
        out[9] = {k.removeprefix("WARC-Source-"): v for k, v in fields.items() if k.startswith("WARC-Source-")} or None
        yield tuple(out)
        at = cut + 8 + size


def to_bytes(records: DataFrame) -> DataFrame:
    """(record_id, data): the serialised records, as a sink writes them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 6):
            rows = [(*r[:9], dict(r[9]) if r[9] else None) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([serialise(r) for r in rows], pa.binary())], ["record_id", "data"])

    return records.select(*_NAMES).mapInArrow(scan, "record_id string, data binary")
