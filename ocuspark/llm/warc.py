"""WARC derivatives: from each response a metadata record and a plain-text conversion record.

Both carry WARC-Refers-To, -Refers-To-Target-URI and -Refers-To-Date of the
response, its target URI, the digest of its payload (Refers-To-Payload-Digest)
and its source headers (as ``source-*`` fields of the metadata block), and name
each other by WARC-Concurrent-To. Identifiers are UUIDs made from type, source
identifier and block, so reruns give the same records. Digests are SHA-1 in
base 32, the usual form.

The conversion is the visible text: comments, scripts and styles go, block
elements end lines, character references are resolved, white space is
collapsed. Metadata lists title, language and the absolute links of anchors, in
order, with repeats once.

Defined cases: null html is an empty payload; a null url leaves the target out
and links stay relative; markup that is never closed ends with the text, at a
cost linear in the page, as all searches go forward.
Repeated responses give repeated records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
HELD = 1 << 22  # characters of markup whose records leave together
CRAWLED = "1970-01-01T00:00:00Z"  # for sources without a date

_BLOCKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li ul ol tr table section article header footer nav blockquote pre title hr".split())
_HIDDEN = frozenset("script style noscript template".split())
_HUGE = re.compile(r"&#\d{4000,};?")
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LOWER = {c: c + 32 for c in range(65, 91)}
_ORIGIN = re.compile(r"https?://[A-Za-z0-9.-]+(?::\d+)?(?=/)")
_ROOTED = re.compile(r"/(?!/)[^\s?#;.\\]*")
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {name}')}>"


@dataclass
class Page:
    """What one pass over the markup gives; texts still hold character references."""

    text: list[str]
    title: list[str]
    lang: str
    hrefs: list[str]


def scan_page(page: str) -> Page:
    """One walk from ``<`` to ``<``; every search goes forward, and one that fails is not made again."""
    out, title, hrefs, lang = [], [], [], None
    low = page.lower()
    if len(low) != len(page):  # a letter that is longer in lower case
        low = page.translate(_LOWER)
    in_title, titled = False, False
    at, size = 0, len(page)
    ends: dict[str, int] = {}

    def after(mark: str, start: int) -> int:
        """Place behind the next mark; the end of the page if there is none."""
        if ends.get(mark, -1) < start:
            found = low.find(mark, start)
            ends[mark] = size if found < 0 else found
        return min(size, ends[mark] + len(mark))

    while at < size:
        here = page.find("<", at)
        if here < 0:
            here = size
        if here > at:
            out.append(page[at:here])
            if in_title:
                title.append(page[at:here])
        if here == size:
            break
        if low.startswith("<!--", here):
            at = after("-->", here + 4)
            out.append(" ")
            continue
        name = _NAME.match(low, here + 1)
        if name is None and low[here + 1 : here + 2] not in ("!", "?", "/"):
            out.append("<")
            if in_title:
                title.append("<")
            at = here + 1
            continue
        at = after(">", here + 1)
        tag = name[0] if name else ""
        if tag in _HIDDEN:
            at = after(">", after(f"</{tag}", at))
            out.append(" ")
            continue
        if tag.lstrip("/") in _BLOCKS:
            out.append("\n")
        if tag == "title":
            in_title, titled = not titled, True
        elif tag == "/title":
            in_title = False
        elif tag == "a":
            found = _HREF.search(page, here + 2, at)
            if found:
                hrefs.append(next((m for m in found.groups() if m), ""))
        elif tag == "html" and lang is None:
            found = _LANG.search(page, here + 5, at)
            lang = found[1] if found else None
    return Page(out, title, (lang or "").lower(), hrefs)


def _resolved(text: str) -> str:
    """Character references resolved; a number of thousands of digits is no character."""
    return html.unescape(_HUGE.sub("\ufffd", text))


def plain_text(page: Page) -> str:
    lines = (" ".join(line.split()) for line in _resolved("".join(page.text)).split("\n"))
    return "\n".join(line for line in lines if line)


def metadata(page: Page, url: str | None) -> dict:
    origin = _ORIGIN.match(url or "")
    links = []
    for href in page.hrefs:
        link = _resolved(href).strip()
        if origin and _ROOTED.fullmatch(link):  # what urljoin gives, without its parsing
            links.append(origin[0] + link)
            continue
        try:
            links.append(urljoin(url or "", link))
        except ValueError:  # not a URL at all: kept as written
            links.append(link)
    title = " ".join(_resolved("".join(page.title)).split())
    return {"title": title, "lang": page.lang, "links": list(dict.fromkeys(x for x in links if x))}


def _record_id(name: Column) -> Column:
    """``record_id`` as an expression: a UUID of version 5 is a SHA-1 with six bits set."""
    sha = F.sha1(F.concat(F.lit(bytearray(SPACE.bytes)), F.encode(name, "UTF-8")))

    def cut(start: int, n: int) -> Column:
        return F.substring(sha, start, n)

    variant = F.translate(cut(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    parts = [cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def responses(pages: DataFrame, date: str = CRAWLED) -> DataFrame:
    """page_id, record_id, target_uri, date, source_headers and payload of response records for a table of pages."""
    url = F.col("url").cast("string")
    name = F.concat_ws(" ", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(url, F.lit("")))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        _record_id(name).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("source_headers"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )


class Response(NamedTuple):
    page_id: int | None
    record_id: str
    target_uri: str | None
    date: str
    source_headers: list[tuple[str, str]] | None
    payload: str


_SCHEMA = (
    "page_id bigint, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, refers_to_date string, "
    "refers_to_digest string, content_type string, content_length bigint, block_digest string, n_links bigint, headers string, block string"
)


def _pair(row: Response) -> list[tuple]:
    source = digest(row.payload.encode())
    page = scan_page(row.payload)
    found, text = metadata(page, row.target_uri), plain_text(page)
    fields = [("title", found["title"]), ("language", found["lang"])]
    fields += [(f"source-{k}", v) for k, v in sorted(row.source_headers or [])]
    fields += [("outlink", x) for x in found["links"]]
    facts = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in fields)
    raws = {"metadata": facts.encode(), "conversion": text.encode()}
    marks = {k: digest(b) for k, b in raws.items()}
    ids = {k: record_id(k, f"{row.record_id} {m}") for k, m in marks.items()}
    out = []
    for kind, other, block, form in (("metadata", "conversion", facts, "application/warc-fields"), ("conversion", "metadata", text, "text/plain; charset=utf-8")):
        raw, mark = raws[kind], marks[kind]
        lines = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", row.date), ("WARC-Target-URI", row.target_uri),
            ("WARC-Refers-To", row.record_id), ("WARC-Refers-To-Target-URI", row.target_uri), ("WARC-Refers-To-Date", row.date),
            ("WARC-Refers-To-Payload-Digest", source), ("WARC-Concurrent-To", ids[other]), ("WARC-Block-Digest", mark),
            ("Content-Type", form), ("Content-Length", str(len(raw))),
        ]
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)
        out.append((row.page_id, kind, ids[kind], row.record_id, ids[other], row.target_uri, row.date, source, form, len(raw), mark, len(found["links"]), head, block))
    return out


def derive(source: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response, with their header lines and blocks."""
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [pa.int64() if c.split()[1] == "bigint" else pa.string() for c in _SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = Response(*(batch.column(c)[i].as_py() for c in Response._fields))
                rows.extend(_pair(row))
                held += len(row.payload)
                if held > HELD or len(rows) >= 1000:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return source.select(*Response._fields).mapInArrow(run, _SCHEMA)


def serialised(records: DataFrame) -> DataFrame:
    """record_id and the bytes of each record as a WARC file holds them."""
    whole = F.concat(F.col("headers"), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"))
    return records.select("record_id", whole.cast("binary").alias("record"))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
