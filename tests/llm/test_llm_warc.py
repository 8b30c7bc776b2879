"""WARC derivatives: records parse back, links and digests hold, texts equal a parser's."""

import hashlib
import re
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from ratewise.llm import warc


class Visible(HTMLParser):
    """Text nodes outside hidden elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template", "title")
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template", "title")
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def parse(record):
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    assert version == "WARC/1.1" and rest[len(block) :] == b"\r\n\r\n"
    return headers, block


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = warc.responses(pages)
    kept = {r["page_id"]: r for r in source.collect()}
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = warc.derive(source, ["page_id"]).collect()
    assert len(rows) == 2 * len(html)
    by = {(r["page_id"], r["warc_type"]): r for r in rows}
    for page, text in html.items():
        of, meta, conv = kept[page], by[page, "metadata"], by[page, "conversion"]
        for r, other in ((meta, conv), (conv, meta)):
            headers, block = parse(r["record"])
            assert headers["WARC-Refers-To"] == r["refers_to"] == of["record_id"] and headers["WARC-Concurrent-To"] == other["derived_id"]
            assert headers["WARC-Target-URI"] == headers["WARC-Refers-To-Target-URI"] == of["target_uri"]
            assert headers["WARC-Source-Payload-Digest"] == of["payload_digest"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
            assert headers["WARC-Block-Digest"] == r["block_digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            assert headers["WARC-Type"] == r["warc_type"] and len(block) == r["content_length"]
        parser = Visible()
        parser.feed(text)
        assert parse(conv["record"])[1].decode().split() == "".join(parser.parts).split()
        assert b"http-content-type: text/html; charset=utf-8\r\n" in parse(meta["record"])[1]
    assert len({r["derived_id"] for r in rows}) == len(rows)


def test_odd_rows(spark):
    fields = "record_id string, target_uri string, date string, http_headers map<string,string>, payload string, payload_digest string, record string, `a.b` int"
    rows = [
        (None, None, None, None, None, None, "r", 1), ("<urn:uuid:1>", "http://x/\r\nWARC-Type: evil", "2020", {"A": "b\nc", "N": None}, "", "sha1:X", "r", 2),
        ("<urn:uuid:2>", "u", "d", {}, "<p>" + "long text " * 50_000, None, None, 3), ("<urn:uuid:2>", "u", "d", {}, "<p>" + "long text " * 50_000, None, None, 3),
        ("<urn:uuid:3>", "u", "d", {}, "<script>never closed <p>x", None, None, 4),
    ]
    out = warc.derive(spark.createDataFrame(rows, fields), ["record", "a.b"])
    assert out.columns[:2] == ["record_source", "a.b"] and out.count() == 10
    by = {(r["a.b"], r["warc_type"]): parse(r["record"]) for r in out.collect()}
    assert "WARC-Target-URI" not in by[1, "conversion"][0] and by[1, "conversion"][1] == b""
    assert by[2, "metadata"][0]["WARC-Type"] == "metadata" and b"http-a: b c\r\n" in by[2, "metadata"][1]
    assert len(by[3, "conversion"][1]) == len("long text " * 50_000) - 1 and by[4, "conversion"][1] == b""
    assert warc.derive(spark.createDataFrame([], fields), []).count() == 0


def test_text_of_small_pages():
    assert warc.plain_text("<h1>A &amp; B</h1><p>one<br>two&nbsp;<b>th</b>ree</p><!-- x <p> -->") == "A & B\none\ntwo three"
    assert warc.plain_text("a < b and 3 > 2 &#x41;&lt;p&gt;") == "a < b and 3 > 2 A<p>"
    assert warc.title_of("<TITLE lang=x> T &copy;\n 1 </TITLE>") == "T © 1"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-p scriptyle&;\"'= \n", max_size=80))
def test_any_page_gives_clean_lines(page):
    text = warc.plain_text(page)
    assert text == text.strip(" \n") and "\n\n" not in text and not re.search("[ \t]{2}", text)


def test_query_returns_the_records(spark):
    import hashlib

    from ratewise.llm.queries import op1_warc_derivatives

    rows = op1_warc_derivatives(spark, "/root/testdata/sf0.001").limit(20).collect()
    assert rows
    for r in rows:
        assert hashlib.sha256(r["record"]).hexdigest() == r["record_sha256"]
        block = bytes(r["record"]).split(b"\r\n\r\n", 1)[1][: r["content_length"]]
        assert "sha256:" + hashlib.sha256(block).hexdigest() == r["block_digest"]
