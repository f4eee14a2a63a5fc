"""WARC archives of pages: deduplicated records cut into segments, written, read back and reassembled.

Writing: a payload of at least ``least`` bytes that an earlier page (smallest page_id) already has
becomes a revisit record; every other page becomes a response record whose HTTP message carries the
payload in chunked transfer framing. A message longer than ``segment_bytes`` is cut: the response
record holds segment 1, continuation records hold the rest and name it as their origin, and the last
states the total length. Archives are gzip files written by Spark in a shared folder, with a bounded
number of records of bounded length each.

Reading: tasks parse whole archives record by record. Unsegmented records are finished on the spot;
segments are grouped by origin identifier, put in order of segment number, checked for gaps and for
the total length, and joined. Then the chunked framing is decoded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = b"\r\n\r\n"
CHUNK_BYTES = 8192
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PARSED = "kind string, page_id long, refers_to long, digest string, payload_bytes long, origin string, segment int, total long, block binary"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(piece), piece) for piece in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken or cut off."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size line is missing")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(message: bytes) -> bytes:
    head, found, body = message.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP header")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(identifier: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    uri = "".join(c for c in url if c > " ") if url else None
    about = [
        ("WARC-Record-ID", f"<urn:uuid:{identifier}>"), ("WARC-Date", "2026-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", page_id), ("X-Payload-Length", len(payload)),
    ]
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record("revisit", [*about, profile, ("X-Refers-To-Page-ID", refers_to)], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    message = HTTP + chunked(payload)
    if len(message) <= segment_bytes:
        yield record("response", about, message)
        return
    pieces = [message[i : i + segment_bytes] for i in range(0, len(message), segment_bytes)]
    for n, piece in enumerate(pieces, 1):
        if n == 1:
            yield record("response", [*about, ("WARC-Segment-Number", 1)], piece)
        else:
            name = hashlib.md5(f"{identifier}/{n}".encode()).hexdigest()
            total = len(message) if n == len(pieces) else None
            yield record("continuation", [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Segment-Origin-ID", f"<urn:uuid:{identifier}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], piece)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        end = archive.find(END, at)
        if end < 0 or archive[at : at + 5] != b"WARC/":
            raise ValueError(f"no record header at byte {at}")
        lines = archive[at:end].decode().split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        if archive[stop : stop + 4] != END:
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, archive[start:stop]
        at = stop + 4


def unzipped(data: bytes) -> bytes:
    """The content of a gzip file of one or more members."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, least: int = 100, segment_bytes: int = 16384, records_per_file: int = 1500) -> None:
    """Write the archives of ``pages`` (page_id, url, html) to ``path``."""
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    source = source.withColumn("digest", F.sha2("payload", 256))
    long_enough = F.length("payload") >= least
    firsts = (
        pages.select(F.col("page_id").cast("long"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
        .filter(long_enough & F.col("page_id").isNotNull())
        .groupBy(F.sha2("payload", 256).alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    known = source.join(firsts, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                count += 1
                identifier = hashlib.md5(f"{path}/{task}/{count}".encode()).hexdigest()
                for one in page_records(identifier, page_id, url, payload, digest, refers_to, segment_bytes):
                    out.append(one)
                    held += len(one)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = known.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "value binary").select(F.col("value").cast("string"))
    # the separator between lines is the pair of line ends that closes a record
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, digest and payload_bytes (as stated), payload (NULL for revisits) of each page.

    Segments that are missing, repeated or of a wrong total length, and broken framing, raise an error.
    """
    schema = pa.schema(
        [
            ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()),
            ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
        ]
    )

    def number(fields: dict[str, str], name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    def reader(segmented: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    out, held = [], 0
                    for fields, block in parse(unzipped(content.as_py())):
                        segment, kind = number(fields, "warc-segment-number"), fields["warc-type"]
                        if (segment is not None) != segmented:
                            continue
                        if not segmented:
                            block = payload_of(block) if kind == "response" else None
                        origin = fields.get("warc-segment-origin-id", fields["warc-record-id"]) if segmented else None
                        digest = fields.get("warc-payload-digest", ":").split(":")[1]
                        out.append((kind, number(fields, "x-page-id"), number(fields, "x-refers-to-page-id"), digest, number(fields, "x-payload-length"), origin, segment, number(fields, "warc-segment-total-length"), block))
                        held += len(block or b"")
                        if held > 4_000_000:
                            yield _rows(out, schema)
                            out, held = [], 0
                    yield _rows(out, schema)

        return run

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    whole = files.mapInArrow(reader(False), PARSED)
    parts = files.mapInArrow(reader(True), PARSED)
    # a group holds the segments of one page
    grouped = parts.groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("kind") == "response", F.col("digest"))).alias("digest"), F.max("payload_bytes").alias("payload_bytes"),
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"),
    )

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, digest, size, total, segments = (c[row].as_py() for c in batch.columns)
                if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                    raise ValueError(f"page {page_id}: segments are missing or repeated")
                message = b"".join(s["block"] for s in segments)
                if len(message) != total:
                    raise ValueError(f"page {page_id}: {len(message)} bytes of {total}")
                yield _rows([("response", page_id, None, digest, size, None, None, None, payload_of(message))], schema)

    joined = grouped.select("page_id", "digest", "payload_bytes", "total", "segments").mapInArrow(reassemble, PARSED)
    return whole.unionByName(joined).select(
        "page_id", F.col("kind").alias("record_type"), "refers_to", "digest", "payload_bytes", F.col("block").alias("payload")
    )


def archive_pages(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write ``pages`` as archives to ``path`` (a new folder) and return what reading them gives.

    One row per row of ``pages``. NULL html counts as empty; rows without page_id are responses;
    a repeated row (page_id and payload) is a response again, as its page_id is the smallest. An
    empty table gives an empty result; further columns are ignored; a NULL url is left out.
    """
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
