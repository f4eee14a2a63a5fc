import gzip
import hashlib

import pytest

from tieout.llm import warc_segments as w
from tieout.llm.common import folder


def test_chunked_framing():
    for payload in (b"", b"a", b"x" * 8192, bytes(range(256)) * 100):
        assert w.unchunked(w.chunked(payload, 1000)) == payload
        assert w.payload_of(w.HTTP + w.chunked(payload)) == payload
    with pytest.raises(ValueError):
        w.unchunked(w.chunked(b"abcdef")[:-8])


def test_records_round_trip():
    payload = b"WARC/1.1\r\n\r\n\r\n\r\n" * 500
    records = list(w.page_records("id", 7, "http://x/ y\r\n", payload, "d", None, 1000))
    archive = b"".join(r + w.END for r in records)
    read = list(w.parse(archive))
    assert len(read) == len(records) > 5 and b"".join(b for _, b in read) == w.HTTP + w.chunked(payload)
    assert [f.get("warc-segment-number") for f, _ in read] == [str(i + 1) for i in range(len(read))]
    assert read[-1][0]["warc-segment-total-length"] == str(len(w.HTTP + w.chunked(payload)))
    with pytest.raises(ValueError):
        list(w.parse(archive[:-2]))
    assert w.unzipped(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"


def test_tables(table):
    long = "é<p>" * 60_000
    rows = [(1, "u1", "x" * 100), (2, "u2", "x" * 100), (2, "u2", "x" * 100), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", "x" * 100), (8, "u", long), (9, "u", long), (1, "again", "x" * 100)]
    pages = table("page_id long, url string, html string, digest string, payload string", [(*r, "c", "c") for r in rows])
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.digest, r.payload) for r in w.archive_pages(pages, folder(pages.sparkSession, "t"), segment_bytes=5000, records_per_file=3).collect()), key=repr)
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = {"x": 1, "é": 8}.get((html or " ")[0])
        revisit = page_id is not None and first is not None and page_id > first
        want.append((page_id or 0, "revisit" if revisit else "response", first if revisit else None, len(raw), hashlib.sha256(raw).hexdigest(), None if revisit else raw))
    assert got == sorted(((a, b, c, d, e, bytearray(f) if f is not None else None) for a, b, c, d, e, f in want), key=repr)
    assert w.archive_pages(pages.limit(0), folder(pages.sparkSession, "t")).count() == 0


def test_missing_segments_are_reported(spark):
    path = folder(spark, "t")
    records = list(w.page_records("id", 7, "u", b"abc" * 3000, "d", None, 1000))
    spark.createDataFrame([(b"".join(r + w.END for r in records[:3] + records[4:]),)], "value binary").selectExpr("cast(value AS string)").write.option("compression", "gzip").text(path)
    with pytest.raises(Exception, match="segments are missing|is cut off|no record header"):
        w.read_archives(spark, path).collect()
