"""WARC archives: write page captures, read them back and reassemble segmented records.

Writing. Every capture is one record: of captures with equal payloads (by SHA-1 and length, from
``min_revisit_bytes`` up) the one with the largest page id is a ``response``, the others are
``revisit`` records without the payload. A response block is an HTTP message whose body has chunked
transfer framing. A block longer than ``SEGMENT_BYTES`` is segmented: the first segment keeps the
record's type, the others are ``continuation`` records that name the first as their origin, carry
rising segment numbers, and the last states the total length. Records are bounded by the segment
size and archives by ``records_per_file``. Spark's text writer puts the archives (one gzip member
each) into any file system Spark can write; its line separator is the record separator CRLF CRLF.

Reading. An archive is a task's unit (``binaryFile``); records are framed by Content-Length. Whole
records are decoded where they are read. Only segments are shuffled: grouped by origin record,
ordered by segment number, checked to be gapless and to have the stated total length, joined,
and then decoded. A group is one capture's block, so its size is that of one payload.

Results: a null payload is an empty one. Rows repeated with the same id and payload are records of
their own (all response if theirs is the largest id). Payloads whose ids are all null are all
responses. Unknown record types are passed over. A segment that arrives twice with equal bytes
counts once. A broken record (framing, gap, total length, digest) raises with its record id.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, reliable_checkpoint

VERSION = b"WARC/1.1"
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4096
RECORDS_PER_FILE = 4000
MAX_BROADCAST = 200_000  # repeated payloads, 40 bytes each
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken chunk framing")
        out.append(body[at : at + n])
        at += n + 2


def _one_line(value: str) -> bytes:
    return " ".join(value.split()).encode()


def _record(headers: list[tuple[str, bytes]], block: bytes) -> bytes:
    lines = [VERSION, *[k.encode() + b": " + v for k, v in headers], b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + SEPARATOR + block


def capture_records(record_id: str, page: int | None, url: str | None, payload: bytes, sha1: str, revisits: int | None,
                    segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record or records of one capture, without the separator behind each."""
    own = [("WARC-Record-ID", f"<{record_id}>".encode()), ("WARC-Date", DATE.encode())]
    about = [("WARC-Target-URI", _one_line(url or "")), ("WARC-Payload-Digest", b"sha1:" + sha1.encode()),
             ("Content-Type", b"application/http; msgtype=response")]
    if page is not None:
        about.append(("X-Page-ID", b"%d" % page))
    if revisits is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record([("WARC-Type", b"revisit"), *own, ("WARC-Profile", PROFILE.encode()),
                       ("X-Refers-To-Page-ID", b"%d" % revisits), *about], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", b"response"), *own, *about], block)
        return
    for k, i in enumerate(range(0, len(block), segment), 1):
        number = ("WARC-Segment-Number", b"%d" % k)
        if k == 1:
            yield _record([("WARC-Type", b"response"), *own, number, *about], block[:segment])
            continue
        headers = [("WARC-Type", b"continuation"), ("WARC-Record-ID", f"<{record_id}:{k}>".encode()),
                   ("WARC-Date", DATE.encode()), number, ("WARC-Segment-Origin-ID", f"<{record_id}>".encode())]
        if i + segment >= len(block):
            headers.append(("WARC-Segment-Total-Length", b"%d" % len(block)))
        yield _record(headers, block[i : i + segment])


def _write_records(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            out, size = [], 0
            for row, page, url, payload, sha1, revisits in zip(*columns):
                for r in capture_records(f"urn:capture:{row}", page, url, payload, sha1, revisits, segment):
                    out.append(r)
                    size += len(r)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["record"])

    return run


def _digests(payload):
    @F.arrow_udf("string")
    def sha1(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([digest(x.as_py()) for x in batch], type=pa.string())

    return sha1(payload)


def write_archives(df: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html",
                   min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write every row of ``df`` as WARC records below ``path``. Text payloads are UTF-8."""
    rows = df.select(F.col(id).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                     F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    # of equal payloads the largest id; combined on the map side, so a hot payload is a few rows
    first = rows.select("page", F.unhex(F.sha1("payload")).alias("sha1"), F.length("payload").alias("bytes")) \
        .filter(F.col("bytes") >= min_revisit_bytes).groupBy("sha1", "bytes").agg(
            F.max("page").alias("largest"), F.count("*").alias("copies")).filter("copies > 1")
    first = reliable_checkpoint(first.select("sha1", "bytes", "largest"))
    keyed = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "bytes": F.length("payload")})
    small = first.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST  # else both sides are shuffled by digest
    joined = keyed.join(F.broadcast(first) if small else first, ["sha1", "bytes"], "left")
    revisits = F.when(F.col("largest").isNotNull() & ~F.col("page").eqNullSafe(F.col("largest")), F.col("largest"))
    # the record id only has to be unique in the archives; a retried task writes its file anew
    captures = joined.select(F.concat(F.coalesce(F.col("page").cast("string"), F.lit("none")), F.lit(":"),
                                      F.monotonically_increasing_id().cast("string")).alias("row"),
                             "page", "url", "payload", _digests(F.col("payload")).alias("b32"), revisits.alias("revisits"))
    records = captures.mapInArrow(_write_records(segment_bytes), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option(
        "lineSep", SEPARATOR.decode()).option("maxRecordsPerFile", records_per_file).text(path)


class _Bytes:
    """Sequential reader of an archive, gzip members or plain."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buffer, self.z = memoryview(raw), 0, bytearray(), None
        self.gzip = raw[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        if self.at >= len(self.raw) and not (self.z and self.z.unconsumed_tail):
            return False
        if not self.gzip:
            self.buffer += self.raw[self.at : self.at + (1 << 20)]
            self.at += 1 << 20
            return True
        self.z = self.z or zlib.decompressobj(31)
        data = bytes(self.raw[self.at : self.at + (1 << 18)])
        self.at += len(data)
        self.buffer += self.z.decompress(data)
        if self.z.eof:  # the next member starts behind this one
            self.at -= len(self.z.unused_data)
            self.z = None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``, which is read too; None at the end."""
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record."""
    source = _Bytes(raw)
    while (head := source.until(SEPARATOR)) is not None:
        version, *lines = head.lstrip(b"\r\n").split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC version line: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode(errors="replace").partition(":") for x in lines)}
        block = source.take(int(headers["content-length"]))
        if source.take(4) != SEPARATOR:
            raise ValueError(f"no separator behind record {headers.get('warc-record-id')}")
        yield headers, block


RECORD = "origin string, type string, page bigint, sha1 string, refers_to bigint, segment int, total bigint, block binary"


def _int(headers: dict[str, str], name: str) -> int | None:
    return int(headers[name]) if name in headers else None


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for h, block in parse_archive(content.as_py()):
                kind = h.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                own = h["warc-record-id"].strip("<>")
                rows.append((h.get("warc-segment-origin-id", own).strip("<>"), kind, _int(h, "x-page-id"),
                             h.get("warc-payload-digest", "").partition(":")[2] or None, _int(h, "x-refers-to-page-id"),
                             _int(h, "warc-segment-number"), _int(h, "warc-segment-total-length"), block))
                size += len(block)
                if size > 8_000_000:
                    yield out(rows)
                    rows, size = [], 0
            yield out(rows)


def decode_http(block: bytes) -> tuple[bytes | None, int | None]:
    """(body with the transfer framing removed, stated length) of an HTTP message."""
    head, mark, body = block.partition(SEPARATOR)
    if not mark:
        raise ValueError("no end of the HTTP headers")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = unchunked(body)
    return body, int(fields[b"content-length"]) if b"content-length" in fields else None


CAPTURE = "struct<payload:binary,payload_bytes:bigint,payload_digest:string>"


def _decoded(origin, kind, sha1, block):
    """Payload, its length and digest; checked against the record's digest. Revisits have no payload."""

    @F.arrow_udf(CAPTURE)
    def decode(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            payloads, sizes, digests = [], [], []
            for o, k, s, b in zip(*[c.to_pylist() for c in batch]):
                try:
                    body, stated = decode_http(b)
                except ValueError as e:
                    raise ValueError(f"record {o}: {e}") from e
                if k == "revisit":
                    body, found = None, s
                else:
                    stated, found = len(body), digest(body)
                    if s is not None and s != found:
                        raise ValueError(f"record {o}: its payload has digest {found}, not {s}")
                payloads.append(body)
                sizes.append(stated)
                digests.append(found)
            yield pa.StructArray.from_arrays(
                [pa.array(payloads, type=pa.binary()), pa.array(sizes, type=pa.int64()), pa.array(digests, type=pa.string())],
                names=["payload", "payload_bytes", "payload_digest"])

    return decode(origin, kind, sha1, block)


def _reassemble(segments: pa.Table) -> pa.Table:
    """One block of the segments of one origin record."""
    rows = sorted({(r["segment"], r["block"]): r for r in segments.to_pylist()}.values(), key=lambda r: r["segment"])
    origin = rows[0]["origin"]
    if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)):
        raise ValueError(f"record {origin}: segments {[r['segment'] for r in rows]}")
    block = b"".join(r["block"] for r in rows)
    if rows[-1]["total"] != len(block):
        raise ValueError(f"record {origin}: {len(block)} bytes in segments, {rows[-1]['total']} stated")
    whole = rows[0] | {"segment": None, "total": len(block), "block": block}
    return pa.Table.from_pylist([whole], schema=segments.schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page, record_type, refers_to, payload BINARY, payload_bytes, payload_digest) of every capture
    in the archives below ``path``; payload is null for revisits."""
    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(_read_records, RECORD)
    segments = records.filter("segment is not null").groupBy("origin").applyInArrow(_reassemble, RECORD)
    (c,) = fresh_names(records, "capture")
    captures = records.filter("segment is null").union(segments).withColumn(
        c, _decoded(F.col("origin"), F.col("type"), F.col("sha1"), F.col("block")))
    return captures.select("page", F.col("type").alias("record_type"), "refers_to", f"{c}.payload", f"{c}.payload_bytes",
                           f"{c}.payload_digest")
