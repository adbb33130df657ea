"""Derivative records of a web archive.

``responses`` wraps raw pages into response records; ``derive`` turns every
response into two records that refer to it: a ``metadata`` record (title,
language, links, the source's HTTP headers and digests) and a ``conversion``
record (the page's plain text). Each derivative keeps the response's target
address and date and names it in ``WARC-Refers-To``; identifiers follow from the
source's identifier, so a task that runs again writes the same records. Digests
are SHA-1 in base 32; a response whose recorded digest is not that of its block
is reported, not dropped.

``write_records`` and ``read_records`` keep records as WARC text files that Spark
writes and splits: a derivative's block holds no carriage return, so the line
ends and the version line between two records occur nowhere else.

Edge cases: null pages or addresses count as empty; a page without text gets an
empty conversion record; equal or repeated pages keep their rows (identifiers
follow from page id and content); an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices, texts_of

VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: The rest of a tag: quoted values may hold its closing sign; a quote that nothing closes does not count.
_REST = r"(?:[^\"'>]*+(?:\"[^\"]*+\"[^\"'>]*+|'[^']*+'[^\"'>]*+)*+>|[^>]*>)"
_BLOCK = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|table|tr|td|th|section|article|nav|header|footer|blockquote|pre|form|main|aside)|br|hr)\b" + _REST, re.I)
#: Comments, scripts and styles run to the end of the page if nothing ends them.
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
#: Other hidden elements: closed ones are hidden whole; an unclosed head ends where something else than its own
#: elements begins, an unclosed noscript or template at the body or the next block.
_HIDDEN = re.compile(r"<head\b(?:[^<]++|<(?!/?head\b|/?body\b))*+</head\s*>"
                     r"|<head\b[^>]*>(?:\s+|<title\b[^>]*>[^<]*(?:</title\s*>)?|<(?:meta|link|base)\b[^>]*>)*"
                     r"|<(noscript|template)\b(?:[^<]++|<(?!/?\1\b))*+</\1\s*>"
                     rf"|<(?:noscript|template)\b[^>]*>(?:(?:[^<]++|<(?!body\b|{_BLOCK.pattern[1:]}))*+(?=<))?", re.I)
_TAG = re.compile(r"</[a-zA-Z][^>]*>|<([a-zA-Z][\w:-]*)(?=[\s/>])" + _REST + r"|<![^>]*>|<\?[^>]*>")
#: Elements of HTML; other names count as tags only with a hyphen or colon (custom and foreign elements).
_ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo bgsound big blink blockquote body br button canvas "
    "caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure "
    "font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe image img input ins isindex kbd keygen label "
    "legend li link listing main map mark marquee math menu menuitem meta meter nav nobr noembed noframes noscript object ol optgroup "
    "option output p param picture plaintext pre progress q rb rp rt rtc ruby s samp script search section select slot small source "
    "span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var "
    "video wbr xmp path g circle rect line polygon".split())
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_LANG = re.compile(r"<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def _without_tag(m: re.Match) -> str:
    name = m.group(1)
    return "" if name is None or name.lower() in _ELEMENTS or "-" in name or ":" in name else m.group()


def _folded(text: str) -> str:
    """Each run of white space as one blank (a substitution would replace every single blank by itself)."""
    return (" " if text[:1].isspace() else "") + " ".join(text.split()) + (" " if text[-1:].isspace() and not text.isspace() else "")


def plain_text(page: str) -> str:
    """Visible text of a page: one line for each block, white space folded."""
    text = _TAG.sub(_without_tag, _BLOCK.sub("\n", _folded(_HIDDEN.sub(" ", _UNSEEN.sub(" ", page)))))
    return "\n".join(filter(None, (" ".join(line.split()) for line in html.unescape(text).split("\n"))))


def one_line(value: str) -> str:
    return " ".join(value.split())


def render(headers: list[tuple[str, str]], block: str) -> str:
    """A record without its end."""
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in headers)]) + "\r\n\r\n" + block


def parse(record: str) -> tuple[dict[str, str], str]:
    """Headers and block of a record; the block is cut to its stated length in bytes."""
    head, _, block = record.partition("\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.split("\r\n")[1:] if ": " in line)
    return headers, block.encode()[:int(headers["Content-Length"])].decode()


def response(page_id: str, url: str, page: str, date: str = DATE) -> str:
    """A response record around a raw page."""
    body = page.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n" + page
    block = http.encode()
    return render([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, digest(body))),
                   ("WARC-Date", date), ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", digest(body)),
                   ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
                   ("Content-Length", str(len(block)))], http)


def derivatives(record: str) -> list[tuple[list[tuple[str, str]], str]]:
    """Headers and blocks of the metadata and the conversion record of a response."""
    source, block = parse(record)
    head, _, page = block.partition("\r\n\r\n")
    status, *http = head.split("\r\n")
    title, lang = _TITLE.search(page), _LANG.search(page)
    links = [one_line(html.unescape("".join(m))) for m in _LINK.findall(page)]
    fields = [("title", one_line(html.unescape(title[1])) if title else ""), ("language", lang[1].lower() if lang else ""),
              ("http-status", one_line(status)), *((f"http-{k.lower()}", one_line(v)) for k, v in (x.split(": ", 1) for x in http if ": " in x)),
              ("source-payload-digest", source.get("WARC-Payload-Digest", "")), ("source-block-digest", source.get("WARC-Block-Digest", "")),
              ("source-digest-ok", str(source.get("WARC-Payload-Digest") == digest(page.encode())).lower()),
              ("links", str(len(links))), *(("outlink", x) for x in dict.fromkeys(links))]
    out = []
    for kind, mime, body in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\n" for k, v in fields)),
                             ("conversion", "text/plain; charset=utf-8", plain_text(page))):
        raw = body.encode()
        out.append(([("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source["WARC-Record-ID"])),
                     ("WARC-Refers-To", source["WARC-Record-ID"]), ("WARC-Date", source["WARC-Date"]),
                     ("WARC-Target-URI", source.get("WARC-Target-URI", "")), ("WARC-Block-Digest", digest(raw)),
                     ("Content-Type", mime), ("Content-Length", str(len(raw)))], body))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """page_id and the response record of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "page"):
                rows = [response(str(i), u, p, date) for i, u, p in zip(part.column("id").to_pylist(), texts_of(part, "url"), texts_of(part, "page"))]
                yield pa.record_batch([part.column("id"), pa.array(rows, pa.string())], names=["page_id", "record"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("page"))
    return rows.mapInArrow(run, "page_id long, record string")


def derive(records: DataFrame) -> DataFrame:
    """The derivative records (column ``record``) of response records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "record"):
                yield pa.record_batch([pa.array([render(*d) for r in texts_of(part, "record") for d in derivatives(r)], pa.string())], names=["record"])

    return records.select("record").mapInArrow(run, "record string")


def write_records(records: DataFrame, path: str) -> None:
    """Derivative records as WARC files, one for each partition."""
    records.select("record").write.mode("overwrite").option("lineSep", RECORD_END).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Headers and block of the records in files of ``write_records``; files are split between tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "value"):
                out = []
                for value in texts_of(part, "value"):
                    if value:
                        headers, block = parse(value if value.startswith(VERSION + "\r\n") else f"{VERSION}\r\n{value}")
                        out.append((headers["WARC-Type"], headers["WARC-Record-ID"], headers["WARC-Refers-To"], headers["WARC-Target-URI"],
                                    headers["WARC-Date"], headers["Content-Type"], int(headers["Content-Length"]), headers["WARC-Block-Digest"],
                                    digest(block.encode()) == headers["WARC-Block-Digest"], block))
                cols = list(zip(*out)) or [[]] * 10
                types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.bool_(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)],
                                      names=["warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type",
                                             "content_length", "block_digest", "digest_ok", "block"])

    rows = spark.read.option("lineSep", f"{RECORD_END}{VERSION}\r\n").text(path)
    return rows.mapInArrow(run, "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, "
                                "content_type string, content_length long, block_digest string, digest_ok boolean, block string")
