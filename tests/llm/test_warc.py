"""WARC derivatives: links, digests, file round trip, awkward rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import time

import pytest

from recallgrid.llm import queries, warc

PAGES = "page_id long, url string, html string, record_id string, headers string"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_links_and_digests(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r["page_id"]: r for r in warc.responses(pages).collect()}
    made = warc.build_derivatives(warc.responses(pages)).collect()
    assert len(made) == 2 * pages.count()
    conversions = {r["record_id"]: r for r in made if r["type"] == "conversion"}
    for r in made:
        source = sources[r["page_id"]]
        assert r["headers"]["WARC-Refers-To"] == source["record_id"]
        assert r["headers"]["WARC-Source-Payload-Digest"] == source["headers"]["WARC-Payload-Digest"] == sha1(source["block"].partition(b"\r\n\r\n")[2])
        assert r["headers"]["WARC-Block-Digest"] == sha1(bytes(r["block"]))
        assert (r["target_uri"], r["date"]) == (source["target_uri"], source["date"])
        if r["type"] == "metadata":
            text = conversions[r["headers"]["WARC-Concurrent-To"]]
            assert text["page_id"] == r["page_id"]
            assert b"http-status: HTTP/1.1 200 OK\r\n" in bytes(r["block"])
    assert queries.op5_warc(spark, sf_dir).count() == len(made)


def visible(page):
    """Visible text of a page by a scanner that looks at one character after another."""
    out, i, low = [], 0, page.lower()
    while i < len(page):
        name = next((n for n in ("script", "style", "noscript", "template") if low.startswith("<" + n, i) and not re.match(r"\w", page[i + 1 + len(n) : i + 2 + len(n)])), None)
        if name or low.startswith("<!--", i):
            end = re.compile(rf"</{name}\s*>" if name else "-->").search(low, i + (1 if name else 4))
            i, c = end.end() if end else len(page), " "
        else:
            i, c = i + 1, page[i]
        out.append(c)
    page = "".join(out)
    blocks = "p div ul ol li h1 h2 h3 h4 h5 h6 tr table article section nav header footer title body head".split()
    for every in (False, True):
        out, i = [], 0
        while i < len(page):
            ends = [j for j in (page.find("<", i + 1), page.find(">", i + 1)) if j >= 0]
            if page[i] == "<" and ends and page[min(ends)] == ">":
                name = re.match(r"/?(\w*)", page[i + 1 : min(ends)].lower())
                starts_line = name[1] in blocks or name[0] == "br"
                if every or starts_line:
                    out.append("" if every else "\n")
                    i = min(ends) + 1
                    continue
            out.append(page[i])
            i += 1
        page = "".join(out)
    lines = [re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip(" ") for x in html.unescape(page).split("\n")]
    return "\n".join(x for x in lines if x).strip()


def test_query_against_a_scanner(spark, sf_dir):
    """Text, lengths and digests of the query's conversion records over all pages."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = {r["page_id"]: r for r in queries.op5_warc(spark, sf_dir).where("type = 'conversion'").collect()}
    assert set(out) == set(pages)
    for i, page in pages.items():
        text = visible(page or "").encode()
        assert (out[i]["content_length"], out[i]["block_sha256"], out[i]["block_digest"]) == (len(text), hashlib.sha256(text).hexdigest(), sha1(text))
    for page in ("a <br b< c <p>d", "<script>x", "<a<!-- -->b>c", "<!-- x", "<style >p</style\n>q<SCRIPTS>r", "<title>t", "3 < 5 > 4"):
        assert warc.plain_text(page) == visible(page)


def test_hostile_pages_take_linear_time():
    began = time.perf_counter()
    for part in ("<!-- ", "<script ", "<script>", "<title>", "<", "<a ", "<html ", "<a href", "&lt;<p "):
        warc.derivatives({"record_id": "r", "headers": {}, "target_uri": "u", "date": "d", "block": b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + part.encode() * 100_000})
    assert time.perf_counter() - began < 30


def test_members_are_read_one_by_one():
    parts = [b"a" * 3_000_000, b"", b"c" * 10]
    data = b"".join(gzip.compress(p) for p in parts)
    assert list(warc.members(data)) == [(p, "") for p in parts]
    assert list(warc.members(b"plain")) == [(b"plain", "")]
    *whole, (cut, error) = warc.members(data[:-9])
    assert (whole, error) == ([(p, "") for p in parts[:2]], "gzip member is cut short")
    assert parts[2].startswith(cut)


def record(name, block=b"xyz", length=None, url="u"):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: {url}\r\n{length if length is not None else f'Content-Length: {len(block)}'}\r\n\r\n".encode() + block + b"\r\n\r\n"


def seen(data):
    return [(r["record_id"], bytes(r["block"]), r["error"]) for r in warc.parse(data)]


@pytest.mark.parametrize(
    ("length", "block", "error"),
    [
        ("Content-Length: x", b"xyz", "Content-Length is no number"), ("Content-Length: -3", b"xyz", "Content-Length is no number"), ("Content-Length: ", b"xyz", "Content-Length is no number"),
        ("X-Other: 1", b"xyz", "no Content-Length"), ("content-length: 3", b"xyz", None), ("CONTENT-LENGTH:2", b"xy", None),
    ],
)
def test_bad_lengths_end_no_job(length, block, error):
    assert seen(record("a", length=length) + record("b")) == [("a", block, error), ("b", b"xyz", None)]


def test_cut_records():
    assert seen(record("a") + record("b")[:-6]) == [("a", b"xyz", None), ("b", b"x", "block is cut short")]
    assert seen(record("a") + b"WARC/1.1\r\nWARC-Record-ID: b\r\nContent-") == [("a", b"xyz", None), ("b", b"", "header is cut short")]
    assert seen(b"") == seen(b"no warc") == []


def test_damaged_members():
    noise = bytes(range(256)) * 40
    one, two, three = (gzip.compress(record(n, noise)) for n in "abc")
    for broken in (two[:12] + bytes(9) + two[21:], two[:-8] + bytes(8), two[:-30], b"\x1f\x8b" + bytes(20)):
        found = seen(one + broken + three)
        assert (found[0], found[-1]) == (("a", noise, None), ("c", noise, None))
        assert [e for _, _, e in found[1:-1]] == ["gzip member is damaged"]
    assert seen(one + bytes(512) + three) == [("a", noise, None), ("c", noise, None)]  # padding


def test_names_without_case_and_nulls(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nhello"
    head = f"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: r\r\nwarc-payload-digest: {sha1(b'other')}\r\ncontent-length: {len(block)}\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(head.encode() + block + b"\r\n\r\n" + record("bad", length="Content-Length: x"))
    back = warc.read_warc(spark.read.format("binaryFile").load(str(tmp_path / "x.warc")))
    assert [(r["record_id"], r["type"], r["error"]) for r in back.collect()] == [("r", "response", None), ("bad", "response", "Content-Length is no number")]
    made = {r["headers"]["WARC-Refers-To"]: bytes(r["block"]) for r in warc.build_derivatives(back).where("type = 'metadata'").collect()}
    assert b"warc-error: payload digest differs" in made["r"]
    assert b"warc-error: no HTTP response" in made["bad"]
    empty = spark.createDataFrame([(None,) * 7], warc.RECORD)
    assert [(r["record_id"], bytes(r["block"]), r["error"]) for r in map(lambda r: next(warc.parse(bytes(r["member"]))), warc.serialized(empty).collect())] == [(None, b"", None)]


def test_only_id_columns_are_kept(spark):
    rows = warc.responses(spark.createDataFrame([(1, "u", "<p>x", "own", "own")], PAGES)).selectExpr("*", "7L as size", "8L as other_id")
    assert warc.build_derivatives(rows).columns == ["page_id", "other_id", *warc.FIELDS]


def test_plain_text():
    page = "<html><head><title>T &amp; U</title><script>var x = '<p>';</script></head><body><p>One<br>two &lt;3</p><!-- no --><style>p{}</style><div>three  four</div></body></html>"
    assert warc.plain_text(page) == "T & U\nOne\ntwo <3\nthree four"


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a/", "<p>x</p>"), (3, "http://a/", "<p>x</p>"), (None, "http://b/", "<title>t</title>" + "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "own", "own") for r in rows], PAGES)
    out = warc.build_derivatives(warc.responses(pages)).collect()
    assert len(out) == 10
    assert len({(r["record_id"], r["type"]) for r in out if r["page_id"] == 3}) == 2
    assert {bytes(r["block"]) for r in out if r["type"] == "conversion" and r["page_id"] in (1, 2)} == {b""}
    assert max(len(r["block"]) for r in out) > 200_000
    assert warc.build_derivatives(warc.responses(pages.where("false"))).count() == 0


def test_broken_sources(spark):
    good = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-A: 1\r\nX-A: 2\r\n\r\n<p>\xe9"
    rows = [("r1", "response", "u", "d", "c", {"WARC-Payload-Digest": "sha1:WRONG"}, good), ("r2", "response", "u", "d", "c", None, b"no http"), ("r3", "response", None, None, None, {}, good), ("r4", "request", "u", "d", "c", {}, good), ("r5", "response", "u", "d", "c", {}, None)]
    out = {(r["headers"]["WARC-Refers-To"], r["type"]): r for r in warc.build_derivatives(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert {k for k, _ in out} == {"r1", "r2", "r3", "r5"}
    assert b"warc-error: payload digest differs" in bytes(out["r1", "metadata"]["block"])
    assert b"warc-error: no HTTP response" in bytes(out["r2", "metadata"]["block"])
    assert bytes(out["r3", "conversion"]["block"]) == "é".encode()
    assert bytes(out["r3", "metadata"]["block"]).count(b"http-header: X-A: ") == 2


def test_file_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>a</title>"), (2, "http://b/", "<p>b\r\n\r\n</p>")], "page_id long, url string, html string")
    made = warc.build_derivatives(warc.responses(pages))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(bytes(r["member"]) for r in warc.serialized(made).collect()))
    back = warc.read_warc(spark.read.format("binaryFile").load(str(tmp_path / "x.warc.gz"))).collect()
    seen = lambda rows: {(r["record_id"], r["type"], r["target_uri"], bytes(r["block"]), tuple(sorted(r["headers"].items()))) for r in rows}
    assert seen(back) == seen(made.collect())
