import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from threadlens.llm import warc as w
from threadlens.session import fresh_path

BIG = "é" * 600
ROWS = [
    (1, "http://a/", "<p>small</p>"), (2, "http://b/", "<p>small</p>"), (3, "http://c/", BIG), (9, "http://d/", BIG), (5, None, BIG),
    (6, "http://e/\r\nWARC-Type: x", None), (7, "http://f/", ""), (8, "http://g/", "x" * 999), (10, "http://h/", "x" * 999),
    (11, "http://i/", "WARC/1.1\r\n\r\n" * 100), (12, "http://j/", "z" * 3_000_000), (13, "http://k/", "z" * 3_000_000), (None, "http://l/", BIG),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(same, default=None)
        revisit = len(data) >= 1000 and top is not None and page != top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.drop("url").collect()), key=repr)


def test_round_trip(spark):
    df = pages(spark, ROWS).withColumns({c: F.lit(1) for c in ("payload_key", "rep_id", "revisits", "n")})
    assert told(w.round_trip(df)) == expected(ROWS)


def test_payloads_come_back(spark):
    got = {r.page_id: r for r in w.round_trip(pages(spark, ROWS), payloads=True).collect()}
    html = {p: h or "" for p, _, h in ROWS}
    for page, r in got.items():
        whole = got[r.refers_to] if r.refers_to is not None else r
        assert whole.payload.decode() == html[page]
    assert got[6].url == "http://e/%0D%0AWARC-Type: x"


def test_edges(spark):
    assert w.round_trip(pages(spark, [])).count() == 0
    twice = [(4, "u", BIG), (4, "u", BIG)]
    assert told(w.round_trip(pages(spark, twice))) == expected(twice)


def test_files_are_one_member_a_record(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    files = w.write_warc(pages(spark, ROWS).coalesce(1), folder).collect()
    assert sum(r.records for r in files) == len(ROWS)
    for r in files:
        data = open(r.path, "rb").read()
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == r.records
        members, rest = 0, data
        while rest:
            one = zlib.decompressobj(31)
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, members = one.unused_data, members + 1
        assert members == r.records and len(data) == r.bytes


def test_files_are_cut_by_size(spark, monkeypatch):
    monkeypatch.setattr(w, "FILE_BYTES", 300)
    folder = fresh_path(spark, "cut")
    files = w.write_warc(pages(spark, ROWS).coalesce(1), folder)
    assert files.count() > 3
    assert told(w.read_warc(files, folder)) == expected(ROWS)


class Source:
    def __init__(self, data):
        self.data = data

    def read(self, n):
        out, self.data = self.data[:n], self.data[n:]
        return out


@pytest.mark.parametrize("piece", [1, 7, 65_536])
def test_reading_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(w, "PIECE", piece)
    data = b"".join(w.member(w.record(i, "u", b"x" * i * 50, None)) for i in range(12))
    got = [w.read_member(m, True) for m in w.Members(Source(data))]
    assert [(r["page_id"], r["payload"]) for r in got] == [(i, b"x" * i * 50) for i in range(12)]


def test_broken_files_raise():
    whole = w.record(3, "u", b"some payload", None)
    read = lambda data: [w.read_member(m) for m in w.Members(Source(data))]
    assert read(w.member(whole))
    for bad in (whole.replace(b"some", b"same"), whole[:-9], whole.replace(b"WARC/1.1", b"WARC/9.9"), whole + b"more"):
        with pytest.raises(ValueError):
            read(w.member(bad))
    with pytest.raises(ValueError):
        read(w.member(whole)[:-12])
