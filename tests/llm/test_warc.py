import gzip
import hashlib
import io
import json
import zlib

import pytest
from odd_rows import by_id

from plumbline.llm import warc

BODY = "<html>" + "ö" * 200 + "</html>"
PAGES = [
    (1, "http://a/1", BODY), (2, "http://a/2\r\nX: y", BODY), (3, None, None), (4, "http://b", ""), (5, "http://c", "short"),
    (6, "http://c", "short"), (7, "http://d", "WARC/1.1\r\n\r\n" * 50), (None, "http://e", BODY), (8, "u", "x" * 700_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS body", "2 AS n", "3 AS original")


def test_records_come_back(spark):
    got = by_id(warc.archived(pages(spark), bodies=True))
    assert len(got) == len(PAGES)
    for row, (page, _, html) in zip(got, sorted(PAGES, key=lambda p: (p[0] is None, p[0]))):
        raw = (html or "").encode()
        assert (row["page_id"], row["payload_bytes"]) == (page, len(raw))
        assert row["payload_digest"] == hashlib.sha256(raw).hexdigest()
        revisit = len(raw) >= 100 and html == BODY and page == 2
        assert row["record_type"] == ("revisit" if revisit else "response")
        assert row["refers_to"] == (1 if revisit else None)
        assert row["body"] == (None if revisit else raw)


def test_members_and_index(spark, tmp_path):
    """A stream of several members and one of a single member become one member per record."""
    records = [warc.record_bytes(i, f"http://x/{i}", b"payload %d" % i, 9, "d", None) for i in range(5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "in" / "many.warc.gz").write_bytes(gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:])))
    files = spark.createDataFrame([("one.warc.gz",), ("many.warc.gz",)], "file string")
    out = warc.normalise(files, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert [r.records for r in out] == [5, 5]
    for row in out:
        archive = (tmp_path / "out" / f"{row.file}.warc.gz").read_bytes()
        entries = [json.loads(x) for x in (tmp_path / "out" / f"{row.file}.idx").read_text().splitlines()]
        assert [zlib.decompress(archive[e["offset"] : e["offset"] + e["length"]], 31) for e in entries] == records
        assert gzip.decompress(archive) == b"".join(records)


def test_a_cut_off_stream_is_an_error():
    packed = gzip.compress(warc.record_bytes(1, "u", b"x" * 1000, 1000, "d", None))
    with pytest.raises(EOFError):
        list(warc.read_records(io.BufferedReader(warc._Unpacked(io.BytesIO(packed[:-20])))))


def test_no_pages(spark):
    assert warc.archived(pages(spark).limit(0)).count() == 0
