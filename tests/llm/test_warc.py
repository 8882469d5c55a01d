import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from slmeval.llm import warc


def expected(rows, least=0):
    largest = defaultdict(lambda: None)
    for p, h in rows:
        if p is not None:
            largest[h or ""] = max(p, largest[h or ""]) if largest[h or ""] is not None else p
    out = []
    for p, h in rows:
        data = (h or "").encode()
        top = largest[h or ""]
        same = p == top or len(data) < least or rows.count((p, h)) == len([r for r in rows if (r[1] or "") == (h or "")]) == 1
        sha1 = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((p, len(data), sha1, "response" if same or top is None else "revisit", None if same or top is None else top))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "x\r\n\r\nWARC/1.1\r\n" * 30), (6, "é" * 5000), (7, "a"), (7, "a"),
        (8, "long" * 9000), (9, "long" * 9000), (None, "a"), (None, "n"), (10, "0\r\n\r\n"), (10, "other")]


def round_trip(spark, tmp_path, rows, **kw):
    df = spark.createDataFrame([(p, f"http://x.org/{p}\r\nX: y", h, 1) for p, h in rows],
                               "page_id long, url string, html string, sha1 int")
    path = str(tmp_path / "w")
    warc.write_archives(df, path, **kw)
    return warc.read_archives(spark, path)


def test_round_trip(spark, tmp_path):
    got = round_trip(spark, tmp_path, ROWS, segment_bytes=700, records_per_file=5).collect()
    rows = sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    assert rows == expected(ROWS)
    payloads = sorted(bytes(r.payload) for r in got if r.record_type == "response")
    assert ("long" * 9000).encode() in payloads and ("é" * 5000).encode() in payloads


def test_least_revisit_size(spark, tmp_path):
    got = round_trip(spark, tmp_path, [(1, "a"), (2, "a"), (3, "bb"), (4, "bb")], min_revisit_bytes=2).collect()
    assert sorted((r.page, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, tmp_path, []).count() == 0


def test_archives_parse_by_content_length(spark, tmp_path):
    round_trip(spark, tmp_path, ROWS, segment_bytes=700)
    records = [r for f in (tmp_path / "w").glob("*.gz") for r in warc.parse_archive(f.read_bytes())]
    kinds = [h["warc-type"] for h, _ in records]
    assert kinds.count("continuation") > 50
    assert all(len(b) <= 700 for _, b in records)
    ids = [h["warc-record-id"] for h, _ in records]
    assert len(ids) == len(set(ids))


def test_members_and_plain_archives():
    parts = [r + warc.SEPARATOR for i in range(3) for r in warc.capture_records(f"urn:{i}", i, None, b"p" * 50, "S", None, 60)]
    whole = list(warc.parse_archive(b"".join(parts)))
    assert list(warc.parse_archive(b"".join(map(gzip.compress, parts)))) == whole and len(whole) > 6
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.parse_archive(b"".join(parts)[:-20]))


def test_chunked_framing():
    for n in (0, 1, 4096, 4097, 10000):
        assert warc.unchunked(warc.chunked(b"z" * n)) == b"z" * n
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_reassembly_checks():
    import pyarrow as pa

    row = {"origin": "o", "type": "response", "page": 1, "sha1": None, "refers_to": None, "segment": 1, "total": None, "block": b"ab"}
    last = row | {"segment": 2, "total": 3, "block": b"c", "type": "continuation"}
    table = lambda *rows: pa.Table.from_pylist(list(rows), schema=pa.schema([
        ("origin", pa.string()), ("type", pa.string()), ("page", pa.int64()), ("sha1", pa.string()), ("refers_to", pa.int64()),
        ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]))
    whole = warc._reassemble(table(last, row, row)).to_pylist()
    assert len(whole) == 1 and whole[0]["block"] == b"abc" and whole[0]["type"] == "response"
    with pytest.raises(ValueError, match="segments"):
        warc._reassemble(table(row, last | {"segment": 3}))
    with pytest.raises(ValueError, match="stated"):
        warc._reassemble(table(row, last | {"total": 9}))
