"""WARC derivatives of broken, long and odd pages."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from skyledger.llm import warc

HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", re.S | re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
TAG = re.compile(r"<[!/?]?([a-zA-Z][a-zA-Z0-9]*)?[^<>]*>")
PARTS = ["<!--", "-->", "<script", "<SCRIPT src=x>", "</script", "</Script >", "<style>", "</style>", "<title", "<title>", "</title>", ">", "<", "a", " ",
         "<template a='<b'>", "</template>", "<scripty>", "\n", "&#65;", "<!-", "/>"]


def test_pages_read_as_plain_patterns_do():
    """Random pages of openers, closers and their halves."""
    rng = random.Random(5)
    for _ in range(20_000):
        page = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        assert warc.visible(page) == HIDDEN.sub(" ", page), page
        found = TITLE.search(page)
        assert warc.title(page) == (found[1] if found else None), page
        assert [m.span() for m in warc._TAG.finditer(page)] == [m.span() for m in TAG.finditer(page)], page


@pytest.mark.parametrize("part", [
    "<!-- a ", "<script>x ", "<script ", "<style", "<title>t ", "<title", "<!--<script><style><noscript><template>", "<", "<aaaa", "a", "<a href=\"x ",
    "<a href='", "<a href = ", "</script ", "&#", "&#x0", " ", "<html lang", "<script></script>", "<!---->", "<meta charset"])
def test_two_megabytes_of_one_part_take_linear_time(part):
    for page in (part * ((2 << 20) // len(part)), part[:-1] + part[-1] * (2 << 20)):
        begin = time.process_time()
        records = warc.derived({"record_id": "r", "target_uri": "http://h/", "date": "d", "http_header": "", "body": page})
        assert len(records) == 2 and time.process_time() - begin < 15


@pytest.mark.parametrize("digits", ["65", "0" * 6000 + "65", "x41", "x" + "0" * 6000 + "41", "9" * 6000, "x" + "f" * 6000, "1114111", "1114112", "0", "00", "x0"])
def test_numbers_of_any_length_resolve(digits):
    for end in (";", "", " z"):
        number = int(digits[1:], 16) if digits[0] == "x" else int(digits[-8:])
        short = f"&#{'x' if digits[0] == 'x' else ''}{min(number, 0x7fffffff) if digits[0] != 'x' else format(min(number, 0x7fffffff), 'x')}{end}"
        assert warc.resolved(f"a&#{digits}{end}") == html.unescape(f"a{short}")


def test_every_header_line_is_carried_in_order(spark):
    header = ("HTTP/1.1 301 Moved\r\nServer: s\r\nSet-Cookie: a=1\r\nX-Long: one\r\n two\r\n\tthree\r\nset-cookie: b=2; c\r\nETag: \"e:f\"\r\n"
              "X-Empty:\r\nno colon\r\nLink: <x>; rel=y\r\n\r\n")
    rows = [("k", "id", "http://h/", "2020-01-01T00:00:00Z", header, "<p>t</p>"), ("k", "id2", None, None, None, None)]
    found = spark.createDataFrame(rows, "page_id string, record_id string, target_uri string, date string, http_header string, body string")
    got = {r.refers_to: r for r in warc.derivatives(found).filter("warc_type = 'metadata'").collect()}
    lines = got["id"].block.split("\r\n")
    assert [x for x in lines if x.startswith("http-")] == [
        "http-status: 301", "http-server: s", "http-set-cookie: a=1", "http-x-long: one two three", "http-set-cookie: b=2; c",
        'http-etag: "e:f"', "http-x-empty: ", "http-link: <x>; rel=y"]
    assert f"source-block-digest: {warc.digest((header + '<p>t</p>').encode())}" in lines
    assert not [x for x in got["id2"].block.split("\r\n") if x.startswith("http-")]


def test_odd_tables(spark):
    """Nulls, repeated rows, clashing names, no rows, and pages that fill several held blocks."""
    schema = "page_id long, url string, html string, record_id string, block string, body string"
    long = "<p>" + "word " * 600_000
    rows = [(None, None, None, "x", "y", "z"), (1, "u", "", "x", "y", "z"), (1, "u", "", "x", "y", "z")] + [(i, "u", long, None, None, None) for i in range(2, 8)]
    pages = spark.createDataFrame(rows, schema).coalesce(1)
    got = warc.derivatives(warc.responses(pages)).select(
        "page_id", "warc_type", "record_id", "refers_to", F.octet_length("block").alias("n"), F.col("block").startswith("word word").alias("whole")).collect()
    assert len(got) == 2 * len(rows)
    texts = [r for r in got if r.warc_type == "conversion"]
    assert sorted((r.page_id or 0, r.n) for r in texts) == [(0, 0), (1, 0), (1, 0)] + [(i, 5 * 600_000 - 1) for i in range(2, 8)]
    same = [r for r in got if r.page_id == 1]
    assert len({(r.warc_type, r.record_id) for r in same}) == 2
    assert len({r.record_id for r in got}) == len(got) - 2
    empty = warc.derivatives(warc.responses(pages.limit(0)))
    assert empty.count() == 0 and empty.columns == warc.derivatives(warc.responses(pages)).columns
