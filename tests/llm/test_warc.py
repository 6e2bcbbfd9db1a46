import base64
import gzip
import hashlib
import time
from html.parser import HTMLParser

import pyarrow as pa
import pytest

from strandgraph.llm import queries, warc

PAGES = [
    (1, "http://a/", "<!DOCTYPE html><html lang='fr'><head><title>T &amp; U</title><style>p{}</style><script>var x='</p>';</script></head><body><p>One<b>two</b> &lt;x&gt;<br>three<!-- no --><a href=\"/y?a=1&amp;b\">l</a></body></html>"),
    (2, None, None), (3, "http://b/", ""), (3, "http://b/", ""), (None, "u", "plain"), (4, "http://c/", "<p>" + "long " * 40_000), (5, "x", "<script>never closed <p>text"),
]


class Reader(HTMLParser):
    """A plain parser, to hold the fast one against."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")
        if tag in warc._BREAKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")
        if tag in warc._BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data.replace("\n", " \n "))


def test_links_headers_and_digests(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, block string")
    sources = warc.responses(df)
    rows = warc.derivatives(sources).collect()
    origin = {r["record_id"]: r for r in sources.collect()}
    assert len(rows) == 2 * len(PAGES)
    for r in rows:
        s = origin[r["refers_to"]]
        assert (r["target_uri"], r["warc_date"], r["payload_digest"]) == (s["target_uri"], s["warc_date"], s["payload_digest"])
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r["block"])).digest()).decode()
        assert r["source_headers"]["status"] == "HTTP/1.1 200 OK" and r["source_headers"]["content-length"] == str(len(warc.split_http(bytes(s["block"]))[2]))
    one = {r["record_type"]: r for r in rows if r["page_id"] == 1}
    assert bytes(one["conversion"]["block"]).decode() == "T & U\nOnetwo <x>\nthreel"
    notes = bytes(one["metadata"]["block"]).decode()
    for x in ("title: T & U", "html-lang: fr", "outlink: /y?a=1&b", f"conversion-record-id: {one['conversion']['record_id']}", f"conversion-digest: {one['conversion']['block_digest']}"):
        assert x + "\r\n" in notes
    assert next(bytes(r["block"]) for r in rows if r["page_id"] == 5 and r["record_type"] == "conversion") == b""


def test_round_trip_of_files(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    records = warc.responses(df).unionByName(warc.derivatives(warc.responses(df)))
    data = warc.to_bytes(records).collect()
    whole = b"".join(gzip.compress(bytes(r["data"])) for r in data)
    back = {r[0]: r for r in warc.parse(gzip.decompress(whole))}
    for r in records.drop("page_id").collect():
        got = back[r["record_id"]]
        assert (got[1], got[2], got[5], got[6], got[7], got[8], got[9]) == (r["record_type"], r["target_uri"], r["refers_to"], bytes(r["block"]), r["block_digest"], r["payload_digest"], r["source_headers"])


def test_text_against_a_parser(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    for page in pages:
        p = Reader()
        p.feed(page)
        p.close()
        want = "\n".join(x for x in (" ".join(y.split()) for y in "".join(p.out).split("\n")) if x)
        assert warc.read_page(page)[0].split() == want.split()


@pytest.mark.parametrize("bit", ["<a ", "<a href=", "<title>", "<!-- ", "<script>", "<", "</", "<html ", "<a>", "<svg></svg>", "<!", "</script", "<p title='", "&"])
def test_unclosed_markup_takes_linear_time(bit):
    page = "<p>x</p>" + bit * ((1 << 20) // len(bit))
    began = time.perf_counter()
    assert warc.read_page(page)[0].startswith("x")
    assert time.perf_counter() - began < 5


def test_small_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([None, "x" * 50, "", *["y" * 10] * 597])], ["i", "t"])
    parts = list(warc._small([batch], 1, 100))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(600)) and all(p.num_rows <= 12 for p in parts)
    assert [p.num_rows for p in warc._small([batch], 1, 1)][:2] == [1, 1] and [p.num_rows for p in warc._small([batch], 1)] == [256, 256, 88]


def test_other_records(spark):
    none = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    records = warc.responses(none)
    other = records.selectExpr("page_id", *(f"'request' AS {c}" if c == "record_type" else c for c in records.columns if c != "page_id"))
    assert warc.derivatives(other).count() == 0 and warc.derivatives(records.limit(0)).count() == 0
    assert [r[1] for r in warc.derive("<r>", None, "d", b"HTTP/1.1 404 Not Found\r\nX: 1\r\nx: 2\r\nbad\r\n\r\nno", None)] == ["metadata"]


def test_query(spark):
    assert queries.op7_warc(spark, "/root/testdata/sf0.001").count() == 2 * 50
