"""WARC derivatives: metadata and plain-text conversion records of responses, linked by their identifiers.

A response gives one conversion record with its text and one metadata record with what its header and page say of it.
Both refer to the response; the metadata record names the conversion as concurrent. Every header line of the source is
carried over, in order and with repeats, and every record has its own block digest beside the digests of its source.
A page is read in time linear in its length, whatever tags it leaves open.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A task holds back records of about so many bytes before it hands them on.
HELD = 8 << 20
RECORD = (
    "warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string,"
    " content_type string, block_digest string, payload_digest string, source_payload_digest string, block string,"
    " n_links long"
)
_OPENERS = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_CLOSERS = {n: re.compile(rf"</{n}\s*+>", re.I) for n in ("script", "style", "noscript", "template", "title")}
_TAG = re.compile(r"<[!/?]?([a-zA-Z][a-zA-Z0-9]*+)?+[^<>]*+>")
_BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr"
    " html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_HREF = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s<>\"']+))", re.I)
_TITLE = re.compile(r"<title\b", re.I)
_LANGUAGE = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", re.I)
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_ZEROS = re.compile(r"&#([xX]?)0{2,}+")
_NO_CHARACTER = re.compile(r"&#(?:[1-9][0-9]{7,}+|[xX][1-9a-fA-F][0-9a-fA-F]{6,}+);?")
_FOLD = re.compile(r"[\r\n]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(*parts: str | None) -> str:
    """A record identifier that follows from what it names."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join('' if p is None else p for p in parts))}>"


def visible(page: str) -> str:
    """The page with a blank for each comment, script, style, noscript and template.

    What is never closed stays as it is. A closer that is missing once is missing for all later openers, which are then
    not searched again.
    """
    kept, at, begin, unclosed = [], 0, 0, set()
    while m := _OPENERS.search(page, at):
        name = (m[1] or "").lower()
        at = m.end()
        if name in unclosed:
            continue
        end = -1
        if not name:
            end = page.find("-->", at) + 3 if page.find("-->", at) >= 0 else -1
        elif (tag := page.find(">", at)) >= 0 and (close := _CLOSERS[name].search(page, tag + 1)):
            end = close.end()
        if end < 0:
            unclosed.add(name)
            if len(unclosed) > 4:
                break
            continue
        kept += [page[begin : m.start()], " "]
        begin = at = end
    return "".join([*kept, page[begin:]])


def title(page: str) -> str | None:
    """What stands in the first title that is closed; None without one."""
    if (m := _TITLE.search(page)) and (tag := page.find(">", m.end())) >= 0:
        if close := _CLOSERS["title"].search(page, tag + 1):
            return page[tag + 1 : close.start()]
    return None


def resolved(text: str) -> str:
    """Entities as characters; a number that no character has, of any length, is the replacement character."""
    return html.unescape(_NO_CHARACTER.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", text)))


def plain_text(shown: str) -> str:
    """Text of what ``visible`` leaves: a line for each block element, entities resolved."""
    body = _TAG.sub(lambda m: "\n" if (m[1] or "").lower() in _BREAKS else "", shown)
    return _LINES.sub("\n", _SPACES.sub(" ", resolved(body))).strip()


def header_fields(header: str) -> list[tuple[str, str]]:
    """All fields of an HTTP header block in order, with repeats, names in small letters; a folded line is one value."""
    fields: list[tuple[str, str]] = []
    for line in header.split("\r\n")[1 if header.startswith("HTTP/") else 0 :]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = fields[-1][0], f"{fields[-1][1]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((_FOLD.sub(" ", name.strip()).lower(), _FOLD.sub(" ", value.strip())))
    return fields


def outlinks(shown: str, base: str) -> list[str]:
    """Absolute targets of links in order, each once; what cannot be resolved stays as it is written."""
    found: dict[str, None] = {}
    for m in _HREF.finditer(shown):
        target = resolved(next((g for g in m.groups() if g is not None), "")).strip()
        try:
            target = urljoin(base, target)
        except ValueError:
            pass
        found[re.sub(r"\s", "%20", target)] = None
    return list(found)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages, with an HTTP header block.

    A null page is an empty body and a null address an empty one. The identifier follows from key, address and body.
    """
    body, address = F.coalesce(F.col(page), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
                      F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    mark = F.md5(F.concat_ws("\n", F.coalesce(F.col(key).cast("string"), F.lit("")), address, body))
    name = F.concat(F.lit("<urn:uuid:"), *_dashed(mark), F.lit(">"))
    return pages.select(
        F.col(key), name.alias("record_id"), address.alias("target_uri"), F.lit(date).alias("date"),
        header.alias("http_header"), body.alias("body"))


def _dashed(mark: Column) -> list[Column]:
    parts = [F.substring(mark, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return [x for p in parts for x in (F.lit("-"), p)][1:]


def derivatives(found: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows per response of ``responses``: its conversion and its metadata record.

    A response without a body gives an empty conversion, one without a header no header fields; identifiers follow from the
    response's, so repeated rows give equal records. An empty table gives no rows. Columns beyond those of ``responses``
    are not read.
    """

    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.int64() if f.endswith("long") else pa.string() for f in RECORD.split(", ")]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, held = [], [], 0
            for i in range(batch.num_rows):
                made = derived(batch.slice(i, 1).to_pylist()[0])
                rows += made
                at += [i, i]
                held += sum(len(r["block"]) for r in made)
                if held > HELD or i + 1 == batch.num_rows:
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array(at, pa.int64()))]
                        + [pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=[key, *names])
                    rows, at, held = [], [], 0

    source = found.select(key, "record_id", "target_uri", "date", "http_header", "body")
    return source.mapInArrow(one, f"`{key}` {found.schema[key].dataType.simpleString()}, {RECORD}")


def derived(r: dict) -> list[dict]:
    page, address = r["body"] or "", r["target_uri"] or ""
    header = r["http_header"] or ""
    source_payload = digest(page.encode())
    source_block = digest((header + page).encode())
    conversion_id = identifier(r["record_id"], "conversion")
    shown = visible(page)
    text = plain_text(shown)
    block = text.encode()
    fields = [("source-block-digest", source_block), ("source-payload-digest", source_payload)]
    if header.startswith("HTTP/"):
        fields.append(("http-status", (header.split("\r\n", 1)[0].split(" ") + [""])[1]))
    fields += [(f"http-{name}", value) for name, value in header_fields(header)]
    for name, pattern in (("charset", _CHARSET), ("language", _LANGUAGE)):
        if m := pattern.search(page):
            fields.append((name, m[1].lower()))
    if (name := title(page)) is not None:
        fields.append(("title", " ".join(resolved(_TAG.sub("", name)).split())))
    fields += [("text-bytes", str(len(block))), ("conversion-record", conversion_id)]
    links = outlinks(shown, address)
    fields += [("outlink", x) for x in links]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields)
    shared = {"refers_to": r["record_id"], "target_uri": address, "date": r["date"], "source_payload_digest": source_payload,
              "n_links": len(links)}
    return [
        shared | {"warc_type": "conversion", "record_id": conversion_id, "concurrent_to": None,
                  "content_type": "text/plain; charset=UTF-8", "block": text, "block_digest": digest(block),
                  "payload_digest": digest(block)},
        shared | {"warc_type": "metadata", "record_id": identifier(r["record_id"], "metadata"),
                  "concurrent_to": conversion_id, "content_type": "application/warc-fields", "block": about,
                  "block_digest": digest(about.encode()), "payload_digest": digest(about.encode())},
    ]


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC/1.1 files, one per partition, through Spark's text writer.

    The blank lines that end a record are the writer's line separator.
    """
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Concurrent-To", F.col("concurrent_to")),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Payload-Digest", F.col("payload_digest")),
        line("WARC-Source-Payload-Digest", F.col("source_payload_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"))
    records.select(head.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
