"""WARC archives: pages written as records of one gzip member each, and a splittable reader.

The reader cuts every file into byte ranges of equal size. A task scans its range for the gzip magic, takes a candidate
as a record only if its bytes inflate to a WARC header, and owns the records that start inside its range, reading on
past the end for the last one. So a file of any size is read by many tasks, and no index is needed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.session import cut_lineage, shared_folder

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 18


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to: the smallest page_id of equal payloads, null for that one itself.

    Digests are compared without moving payloads: only digests and ids are shuffled, and only those of payloads that
    occur twice are joined back. Payloads under ``least_bytes`` are never revisits. Null html is an empty payload. A
    null page_id gives way to any other; equal rows are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("_sha1", F.sha1(F.col("html").cast("binary"))).withColumn("_size", F.octet_length("html"))
    twice = keyed.where(F.col("_size") >= least_bytes).groupBy("_sha1", "_size").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    joined = keyed.join(cut_lineage(twice.drop("_n")), ["_sha1", "_size"], "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("_first")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the HTTP header, which names the length of the payload, and leaves out the payload."""
    name = "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c if c.isprintable() else "%{:02X}".format(ord(c) & 0xFF) for c in url) if url else ""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html, refers_to) as .warc.gz files, one per task, and return (path, bytes).

    Files go to a new folder below ``folder`` or the session's shared folder. Each attempt of a task writes a file of
    its own name and only those of attempts that succeeded are returned, so retries leave no record twice.
    """
    place = f"{(folder or shared_folder(pages.sparkSession)).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(place)
        store.create_dir(root, recursive=True)
        path, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    size += out.write(_gzip(_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)))
        yield pa.RecordBatch.from_arrays([pa.array([f"{place}/{path.rsplit('/', 1)[1]}"]), pa.array([size], pa.int64())], names=["path", "bytes"])

    return cut_lineage(pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, bytes long"))


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _inflate(file: pa.NativeFile, data: bytes, at: int, offset: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``data[at]`` and the file offset behind it; None if it is no WARC record.

    ``data`` starts at ``offset``; what lies beyond it is read from the file, chunk by chunk.
    """
    inflater = zlib.decompressobj(31)
    parts: list[bytes] = []
    checked = False
    chunk, position = data[at:], offset + len(data)
    try:
        while True:
            parts.append(inflater.decompress(chunk))
            if not checked:
                seen = b"".join(parts)
                if not b"WARC/1.".startswith(seen[:7]):
                    return None
                parts, checked = [seen], len(seen) >= 7
            if inflater.eof:
                break
            file.seek(position)
            chunk = file.read(READ_BYTES)
            if not chunk:
                return None
            position += len(chunk)
    except zlib.error:
        return None
    whole = b"".join(parts)
    return (whole, position - len(inflater.unused_data)) if whole.startswith(b"WARC/1.") else None


def records_in_range(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    """The records that start at offsets from ``start`` up to ``stop``."""
    offset = start
    while offset < stop:
        file.seek(offset)
        data = file.read(min(READ_BYTES, stop - offset) + len(MAGIC) - 1)
        at = data.find(MAGIC)
        if at < 0:
            offset += max(1, len(data) - len(MAGIC) + 1)
            continue
        if offset + at >= stop:
            return
        found = _inflate(file, data, at, offset)
        if found is None:
            offset += at + 1
        else:
            yield found[0]
            offset = found[1]


def parse_record(record: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:] if ": " in line)
    return {"fields": fields, "http": {k.lower(): v for k, v in inner.items()}, "payload": payload}


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of ``files`` (path, bytes): page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    payload_bytes and payload_digest describe the full payload also of a revisit, whose payload is null. The digest of
    a response is that of the bytes read; one that differs from its header ends the job.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start")).select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"))
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    )

    def page_of(urn: str | None) -> int | None:
        name = (urn or "")[len("<urn:page:") : -1]
        return int(name) if name else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = _store(path)
                rows, size = [], 0
                with store.open_input_file(inner) as file:
                    for record in records_in_range(file, start, stop):
                        r = parse_record(record)
                        f, kind = r["fields"], r["fields"]["warc-type"]
                        digest = f["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and payload_digest(r["payload"]) != digest:
                            raise ValueError(f"digest of {f['warc-record-id']} in {path} does not match its payload")
                        payload = r["payload"] if kind == "response" else None
                        rows.append((page_of(f["warc-record-id"]), f["warc-target-uri"] or None, kind, page_of(f.get("warc-refers-to")), digest, int(r["http"]["content-length"]), payload))
                        size += len(record)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    tasks = max(1, min(ranges.count(), 100_000))
    spread = ranges.repartitionByRange(tasks, "path", "start")
    columns = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    return spread.mapInArrow(read, columns)
