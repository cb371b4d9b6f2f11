"""WARC archives: written from pages, read back and assembled into one nested row per capture.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record. Requests and metadata name the response or revisit they belong to in
WARC-Concurrent-To; the reader joins the records of a capture by these identifiers.

Archives are written by Spark's text writer, whose line separator is the end of a WARC record,
and read as binary files that are cut by Content-Length, so payloads may hold anything.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, shuffles_freed, table

VERSION = "WARC/1.1"
END = "\r\n\r\n"
#: Archive files hold at most this many bytes before compression; a longer capture has a file of its own.
FILE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "type string, id string, concurrent_to string, refers_to string, target_uri string, date string, digest string, content_length long, payload_bytes long, payload_digest string, block binary"


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, rid: str, block: bytes, **fields: str | None) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    head += [f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + END).encode() + block


def _clean(url: str | None) -> str | None:
    """A header value: one line."""
    return None if url is None else "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in url)


def _capture(r: dict, date: str) -> bytes:
    """The three records of a page."""
    payload = (r["html"] or "").encode("utf-8")
    mine, url = _urn("capture", r["rid"]), _clean(r["url"])
    common = {"WARC_Date": date, "WARC_Target_URI": url}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}".encode() + b"\r\n\r\n"
    digest = f"sha1:{_sha1(payload)}"
    if r["rid"] == r["keep_rid"]:
        first = _record("response", mine, head + payload, **common, WARC_Payload_Digest=digest, Content_Type="application/http; msgtype=response")
    else:
        first = _record("revisit", mine, head, **common, WARC_Payload_Digest=digest, WARC_Refers_To=_urn("capture", r["keep_rid"]), WARC_Profile=PROFILE, Content_Type="application/http; msgtype=response")
    request = _record("request", _urn("request", r["rid"]), f"GET {url or '/'} HTTP/1.1\r\n\r\n".encode(), **common, WARC_Concurrent_To=mine, Content_Type="application/http; msgtype=request")
    page = "" if r["page_id"] is None else f"page-id: {r['page_id']}\r\n"
    metadata = _record("metadata", _urn("metadata", r["rid"]), page.encode(), **common, WARC_Concurrent_To=mine, Content_Type="application/warc-fields")
    return END.encode().join([first, request, metadata])


def _archives(date: str, file_bytes: int):
    """A row for each archive: captures of a task in their order, as many as file_bytes hold."""

    def row(held: list[bytes], size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.large_string() if size > 1 << 30 else pa.string())], ["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                capture = _capture(r, date)
                if held and size + len(capture) + len(END) > file_bytes:
                    yield row(held, size)
                    held, size = [], 0
                held.append(capture)
                size += len(capture) + len(END)
        if held:
            yield row(held, size)

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str | None = "gzip", file_bytes: int = FILE_BYTES, scratch: Scratch | None = None) -> None:
    """Writes pages (page_id, url, html) as WARC records into the folder path.

    Of rows with equal payloads of at least min_bytes, the one with the largest page_id (null
    ids smallest, one of any repeated rows) is the response and the others revisit it. Null html
    is an empty payload. An empty table leaves an empty archive. A file holds no more than file_bytes
    before compression, or one longer capture, whatever order pages of different lengths come in.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    # payloads are equal if their SHA-256 and lengths are; digests and ids alone are grouped
    data = F.coalesce("html", F.lit("")).cast("binary")
    rows = scratch.numbered(pages.select("page_id", "url", "html", F.sha2(data, 256).alias("digest"), F.length(data).cast("long").alias("n")))
    long_enough = F.col("n") >= min_bytes
    # stored, so that rows of a hot payload can be split over tasks
    keep = scratch.store(rows.where(long_enough).groupBy("digest", "n").agg(F.max(F.struct("page_id", "rid"))["rid"].alias("keep_rid")))
    marked = rows.join(keep, ["digest", "n"], "left").withColumn("keep_rid", F.when(long_enough, F.col("keep_rid")).otherwise(F.col("rid")))
    archives = marked.select("rid", "page_id", "url", "html", "keep_rid").mapInArrow(_archives(date, file_bytes), "value string")
    with shuffles_freed(pages.sparkSession):
        archives.write.option("maxRecordsPerFile", 1).text(path, compression=compression, lineSep=END)
    scratch.drop(rows, keep)


def _unpacked(data: bytes) -> bytes:
    """The bytes of plain or gzip (one or many members) archives."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        d = zlib.decompressobj(31)
        parts.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(parts)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive."""
    data, at = _unpacked(data), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        split = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:split].decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = data[split + 4 : split + 4 + size]
        if len(block) != size:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block
        at = split + 4 + size


def _parsed(with_block: bool):
    schema = pa.schema([("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("content_length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                out, held = [], 0
                for f, block in parse_records(content.as_py()):
                    kind = f.get("warc-type")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    out.append((kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-payload-digest"), len(block), None if payload is None else len(payload), None if payload is None else _sha1(payload), block if with_block or kind == "metadata" else None))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    return run


def read_records(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """Every record of the archives in a folder; blocks of metadata always, others on request."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed(with_block), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: id, url, date, response (or revisit), request, metadata, and for
    revisits the record they refer to. Records that name no capture, or one that isn't there,
    are left out; captures without request or metadata have null there; of records that repeat
    an identifier the first by content stays."""
    one = lambda kind, key: records.where(F.col("type") == kind).groupBy(F.col(key).alias("capture"))
    request = one("request", "concurrent_to").agg(F.min(F.struct("id", "content_length", "block")).alias("request"))
    metadata = one("metadata", "concurrent_to").agg(F.min(F.struct("id", "block")).alias("metadata"))
    captures = records.where(F.col("type").isin("response", "revisit")).select(F.col("id").alias("capture"), "type", "target_uri", "date", F.struct("digest", "payload_bytes", "payload_digest", "content_length", "block").alias("response"), "refers_to")
    whole = captures.join(request, "capture", "left").join(metadata, "capture", "left")
    return whole.select("capture", "type", "target_uri", "date", "request", "response", "metadata", "refers_to")


def captures_with_origin(assembled: DataFrame) -> DataFrame:
    """Adds page_id (null where the metadata name none, or one that is no whole number) and origin,
    the page and payload of the response that a revisit refers to."""
    page = F.regexp_extract(F.col("metadata.block").cast("string"), r"page-id: (-?\d+)", 1)
    rows = assembled.withColumn("page_id", F.when(page != "", page).cast("long"))
    origin = rows.where("type = 'response'").select(F.col("capture").alias("o_capture"), F.struct("page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")).alias("origin"))
    return rows.join(origin, rows["refers_to"] == origin["o_capture"], "left").drop("o_capture")


def op7_warc(spark, sf_dir):
    scratch = Scratch(spark, "warc")
    archive = f"{scratch.base}/archive"
    write_archives(table(spark, sf_dir, "pages"), archive, scratch=scratch)
    records = scratch.store(read_records(spark, archive, with_block=False))
    # stored, so that the revisits of a hot response can be split over tasks
    c = captures_with_origin(scratch.store(assemble(records)))
    return c.select(
        "page_id",
        F.coalesce("response.payload_bytes", "origin.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "origin.payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("origin.page_id").alias("refers_to"),
    )
