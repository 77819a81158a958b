"""WARC derivatives: metadata and plain-text conversion records from responses.

A response yields a metadata record (status line and headers of the response, title, language, outlinks, as warc-fields)
and a conversion record (its text). Both refer to the response by WARC-Refers-To and keep its target URI, its date and
its payload digest; each has a digest of its own block. Records are bytes in the WARC 1.1 form and can be parsed back.

Pages are read by one scan from left to right, so the time is in proportion to the page whatever it holds. Scripts,
styles and titles end at their closing tag or with the page, as HTML has it; noscript and template are passed over only
where they are closed, so an element left open loses no text.

Defined cases: a null page is an empty payload; a null URL leaves WARC-Target-URI out; record ids follow from page id, URL, date
and content, so rows repeated in full name one record and others never share an id; a record that cannot be read, or is
no response, gives one row of type ``error`` that says why; a record without a block digest is taken as it is; pages of
any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import map_batches, table

CRAWL_DATE = "2020-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard namespace for URLs

# Fixed lists: elements whose inside is no text (the first three end only at their closing tag or with the page), and
# elements that break a line.
RAW, CLOSED = ("script", "style", "title"), ("noscript", "template")
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


class Page:
    """Text, title, language and outlinks of an HTML page, in one scan."""

    def __init__(self, page: str):
        self.parts: list[str] = []
        self.title: str | None = None
        self.lang: str | None = None
        self.links: dict[str, None] = {}
        self.page = page
        self.closing: dict[str, int] = {}  # where the next closing tag of a name is, as far as looked for
        self.next_at: dict[str, int] = {}  # likewise the next >, " and '
        self._scan(page)
        self.text = _LINES.sub("\n", _BLANKS.sub(" ", html.unescape("".join(self.parts)))).strip()

    def _next_close(self, page: str, name: str, at: int) -> int:
        """The next closing tag of a name from ``at`` on; len(page) without one. What was found is not sought again."""
        known = self.closing.get(name, -1)
        if known < at:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            known = self.closing[name] = m.start() if m else len(page)
        return known

    def _next(self, sign: str, at: int) -> int:
        known = self.next_at.get(sign, -1)
        if known < at:
            known = self.page.find(sign, at)
            known = self.next_at[sign] = len(self.page) if known < 0 else known
        return known

    def _tag_end(self, at: int) -> int:
        """The first > from ``at`` on that is in no quoted value; a quote that is never closed opens none. len(page) without any."""
        pos, n = at, len(self.page)
        while True:
            to = self._next(">", pos)
            quote = min(self._next('"', pos), self._next("'", pos))
            if quote >= to:
                return to
            before = quote - 1
            while before > at and self.page[before].isspace():
                before -= 1
            close = self._next(self.page[quote], quote + 1) if self.page[before] == "=" else n
            if close < n and self._next(">", close) == n:  # the value would take in all that is left
                self.next_at.clear()
                return self.page.find(">", at) if to < n else n
            pos = quote + 1 if close == n else close + 1

    def _scan(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.parts.append(page[at:])
                return
            self.parts.append(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                self.parts.append(" ")
                at = n if end < 0 else end + 3
                continue
            after = page[lt + 1 : lt + 3]
            slash = after[:1] == "/"
            name = _NAME.match(page, lt + 1 + slash)
            if not name and after[:1] not in ("!", "?"):
                self.parts.append("<")
                at = lt + 1
                continue
            end = self._tag_end(lt + 1)
            if end == n:  # no tag ends from here on: what is left is text
                self.parts.append("<")
                at = lt + 1
                continue
            at = end + 1
            if not name:
                continue
            kind = name[0].lower()
            if kind in BREAKS:
                self.parts.append("\n")
            if slash:
                continue
            if kind in ("a", "html"):
                self._attributes(kind, page[name.end() : end])
            elif kind in RAW or kind in CLOSED:
                close = self._next_close(page, kind, at)
                if kind in CLOSED and close == n:
                    continue
                if kind == "title" and self.title is None and close < n:
                    self.title = " ".join(html.unescape(page[at:close]).split())
                self.parts.append(" ")
                stop = page.find(">", close) if close < n else -1
                at = n if stop < 0 else stop + 1

    def _attributes(self, kind: str, inside: str) -> None:
        wanted = "href" if kind == "a" else "lang"
        for m in _ATTRIBUTE.finditer(inside):
            if m[1].lower() == wanted:
                value = html.unescape(next((v for v in m.group(2, 3, 4) if v is not None), ""))
                if kind == "a":
                    self.links[value] = None
                elif self.lang is None:
                    self.lang = value
                return


def plain_text(page: str) -> str:
    return Page(page).text


def outlinks(page: str) -> list[str]:
    return list(Page(page).links)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of a WARC file's bytes; raises ValueError where the form or a block digest is broken."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError("no record header")
        head = {}
        for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, colon, v = x.partition(":")
            if not colon:
                raise ValueError("a header without a colon")
            head[k.strip()] = v.strip()
        size = head.get("Content-Length", "")
        if not size.isdecimal():
            raise ValueError("no content length")
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size) + 4
        if data[at - 4 : at] != b"\r\n\r\n" or head.get("WARC-Block-Digest", digest(block)) != digest(block):
            raise ValueError("damaged record")
        out.append((head, block))
    if not out:
        raise ValueError("no record")
    return out


def _urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(parts))}>"


def response(url: str | None, page: str | None, date: str = CRAWL_DATE, page_id: int | None = None) -> bytes:
    payload = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    rid = _urn("response", str(page_id), url or "", date, digest(payload))
    return record([("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", _line(url)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", digest(payload))], block)


def _line(x: str | None) -> str | None:
    return None if x is None else re.sub(r"[\r\n]+", " ", x)


def derive(warc: bytes) -> list[bytes]:
    """The metadata and conversion records of a response record; raises ValueError for anything else."""
    records = parse(warc)
    if len(records) != 1 or records[0][0].get("WARC-Type") != "response":
        raise ValueError("not a response")
    head, block = records[0]
    missing = [k for k in ("WARC-Record-ID", "WARC-Date") if k not in head]
    if missing:
        raise ValueError(f"no {missing[0]}")
    cut = block.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("no end of the response's headers")
    source, payload = block[:cut].decode("utf-8", "replace").split("\r\n"), block[cut + 4 :]
    page = Page(payload.decode("utf-8", "replace"))
    fields = [("http-status", source[0]), *(("http-header", x) for x in source[1:]), ("title", page.title), ("language", page.lang), *(("outlink", x) for x in page.links)]
    meta = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields if v is not None).encode()
    source_digest = head.get("WARC-Payload-Digest") or digest(payload)
    out = []
    for kind, content, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", page.text.encode())):
        rid = _urn(kind, head["WARC-Record-ID"])
        out.append(record([("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Refers-To", head["WARC-Record-ID"]), ("WARC-Date", head["WARC-Date"]), ("WARC-Target-URI", head.get("WARC-Target-URI")), ("WARC-Source-Payload-Digest", source_digest), ("Content-Type", content)], body))
    return out


DDL = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, source_payload_digest string, block_digest string, content_length long, content string, error string, warc binary"


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, warc): each page as a response record."""

    def make():
        return lambda c: {"page_id": c["page_id"], "warc": [response(u, h, page_id=i) for i, u, h in zip(c["page_id"], c["url"], c["html"], strict=True)]}

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), make, "page_id long, warc binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows a response record, as bytes and in columns; one of type ``error`` for what is none."""

    def make():
        names = [x.split()[0] for x in DDL.split(", ")]

        def f(c):
            rows = []
            for page, warc in zip(c["page_id"], c["warc"], strict=True):
                try:
                    for out in derive(warc or b""):
                        ((h, block),) = parse(out)
                        rows.append((page, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"), h["WARC-Date"], h["Content-Type"], h["WARC-Source-Payload-Digest"], h["WARC-Block-Digest"], len(block), block.decode(), None, out))
                except ValueError as e:
                    rows.append((page, "error", *[None] * 9, str(e), warc))
            return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return f

    return map_batches(records, make, DDL)


def op8_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages"))).drop("warc")
