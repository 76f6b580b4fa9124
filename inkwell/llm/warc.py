"""WARC archives as Spark writes and reads them: records, revisits, and a chunked record table.

Writing: each task appends records, one gzip member each, to files of about FILE_BYTES in the shared folder; a file has
its name only when it is complete, and only files of the written manifest count, so repeated tasks do no harm. Payloads go
through the compressor piece by piece. Reading: a task streams a file and yields rows (record, chunk number, data) of
CHUNK_BYTES at most with the digest and the length so far; no record is ever held as a whole.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import artifacts, common
from inkwell.llm.dedup import near

CHUNK_BYTES = 1 << 20
FILE_BYTES = 64 << 20
SMALL = 1000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "path string, records bigint, bytes bigint"
CHUNKS = "page_id bigint, record_id string, record_type string, refers_to bigint, url string, chunk_no bigint, data binary, bytes_so_far bigint, digest_so_far string, header_digest string, header_bytes bigint, last boolean"


def with_revisits(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", smallest: int = SMALL) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, sha1, record_type, refers_to of each page.

    Of equal payloads (by SHA-256) of at least `smallest` bytes the page with the largest key is a response and the others
    revisit it; smaller ones are all responses. Null payloads are empty, null URLs stay null. Rows with a null key revisit or
    are responses like others and are never the largest; rows that tie for the largest key are all responses. Keys are
    integers. Payloads may be of any length; an empty table gives an empty table; other columns are left out.
    Only digests are grouped. The groups' keys are broadcast if they are few; else rows are joined by digest, where those
    without one, dealt by their own keys, find nothing and meet in no task.
    """
    packed = common.Packed(pages)
    body = F.encode(F.coalesce(packed.column(payload), F.lit("")), "UTF-8")
    rows = packed.docs.select(packed.column(key).cast("bigint").alias("page_id"), packed.column(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    same = F.when(F.col("payload_bytes") >= smallest, F.unhex(F.sha2("payload", 256)))
    groups = rows.select("page_id", same.alias("same")).filter("same is not null").groupBy("same").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1 and newest is not null").select("same", "newest")
    groups = common.written(groups, "warc-groups")
    own = F.encode(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), "UTF-8")
    rows = rows.withColumn("same", F.coalesce(same, own)).join(near(groups, groups.count()), "same", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return rows.select("page_id", "url", "payload", "payload_bytes", F.sha1("payload").alias("sha1"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("newest")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def _header(page_id, url, kind, refers_to, digest, n) -> tuple[bytes, bytes]:
    """The WARC header and what comes before the payload in the block."""
    before = _HTTP % n if kind == "response" else b""
    length = len(before) + (n if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 2026-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}", "Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), before


def write_archives(records: DataFrame, folder: str, *, level: int = 3, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records of with_revisits() below folder (shared by all executors); the manifest of the files, written.

    Each row is one record, repeated rows each their own. Null payloads and URLs are as with_revisits() has them. A payload goes
    through the compressor in pieces of CHUNK_BYTES. No rows give no files and an empty manifest.
    """
    common.small_batches(records.sparkSession, 64)
    columns = ("page_id", "url", "payload", "payload_bytes", "sha1", "record_type", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.__exit__(None)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, _, length, digest, kind, refers_to = (batch.column(c)[k].as_py() if c != "payload" else None for c in columns)
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = artifacts.Output(path)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                header, before = _header(page_id, url, kind, refers_to, digest, length)
                pieces = [header, before]
                if kind == "response":
                    view = memoryview(batch.column("payload")[k].as_buffer())
                    pieces += [view[at : at + CHUNK_BYTES] for at in range(0, len(view), CHUNK_BYTES)]
                for piece in (*pieces, b"\r\n\r\n"):
                    size += _put(out, packer.compress(piece))
                size += _put(out, packer.flush())
                n += 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return common.written(records.select(*columns).mapInArrow(write, MANIFEST), "warc-manifest")


def _put(out, data: bytes) -> int:
    if data:
        out.write(data)
    return len(data)


class _Stream:
    """The bytes of a file of gzip members (or of plain records), a piece at a time."""

    def __init__(self, source, packed: bool):
        self.source, self.packed, self.raw, self.ready = source, packed, b"", bytearray()
        self.unpacker = zlib.decompressobj(31) if packed else None

    def more(self) -> bool:
        """Get some more bytes ready; False at the end."""
        if not self.packed:
            data = self.source.read(CHUNK_BYTES)
            self.ready += data
            return bool(data)
        while True:
            if not self.raw:
                self.raw = self.source.read(1 << 18)
                if not self.raw:
                    return False
            if self.unpacker.eof:
                self.unpacker = zlib.decompressobj(31)
            data = self.unpacker.decompress(self.raw, CHUNK_BYTES)
            self.raw = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if data:
                self.ready += data
                return True

    def head(self) -> bytes | None:
        """A header up to its empty line; None at the end of the file."""
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.ready.strip():
                    raise ValueError("a WARC file ends within a header")
                return None
        out = bytes(self.ready[:at])
        del self.ready[: at + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces of CHUNK_BYTES (the last may be shorter)."""
        while n:
            want = min(n, CHUNK_BYTES)
            while len(self.ready) < want:
                if not self.more():
                    raise ValueError("a WARC file ends within a record")
            yield bytes(self.ready[:want])
            del self.ready[:want]
            n -= want


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def chunks_of(source, packed: bool = True) -> Iterator[tuple]:
    """Rows of CHUNKS of all records of an open file; a record without payload is one row without data."""
    stream = _Stream(source, packed)
    while (header := stream.head()) is not None:
        f = _fields(header)
        n, digest, done, number = int(f["content-length"]), hashlib.sha1(), 0, 0
        common_ = (int(f["x-page-id"]) if "x-page-id" in f else None, f.get("warc-record-id"), f.get("warc-type"), int(f["x-refers-to-page"]) if "x-refers-to-page" in f else None, f.get("warc-target-uri"))
        claimed = (f.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(f["x-payload-length"]) if "x-payload-length" in f else None)
        if n and f.get("content-type", "").startswith("application/http"):
            n -= len(stream.head() or b"") + 4
        if not n:
            yield (*common_, 0, b"", 0, digest.hexdigest(), *claimed, True)
        left = n
        for piece in stream.take(n):
            digest.update(piece)
            done, left = done + len(piece), left - len(piece)
            yield (*common_, number, piece, done, digest.hexdigest(), *claimed, not left)
            number += 1
        for _ in stream.take(4):
            pass


def read_archives(spark: SparkSession, manifest: DataFrame, *, data: bool = True) -> DataFrame:
    """The chunked record table of the manifest's files, a file to a task. data: whether chunks bring their bytes.

    Records come in the order of their files; record_id and chunk_no name a chunk. A record without payload is one chunk
    without data; headers that lack an extension's fields give nulls. A record of any length is read in chunks of CHUNK_BYTES.
    A file that ends within a record raises an error. An empty manifest gives no rows.
    """
    common.small_batches(spark, 64)
    names = [x.strip().split(" ")[0] for x in CHUNKS.split(",")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[x.strip().split(" ")[1]]) for n, x in zip(names, CHUNKS.split(","), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = artifacts.store(path)
                with files.open_input_stream(at, compression=None) as source:
                    held, size = [], 0
                    for row in chunks_of(source, path.endswith(".gz")):
                        row = row if data else (*row[:6], None, *row[7:])
                        held.append(row)
                        size += len(row[6] or b"") + 300
                        if size >= 4 * CHUNK_BYTES:
                            yield _rows(held, schema)
                            held, size = [], 0
                    if held:
                        yield _rows(held, schema)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(read, CHUNKS)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def records(chunks: DataFrame) -> DataFrame:
    """A row for each record, from its last chunk: a response's length and digest as streamed, a revisit's as its header says.

    A response whose streamed digest isn't that of its header raises an error.
    """
    last = chunks.filter("last")
    response = F.col("record_type") == "response"
    wrong = response & F.col("header_digest").isNotNull() & (F.col("header_digest") != F.col("digest_so_far"))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("digest of "), F.col("record_id")))).when(response, F.col("digest_so_far")).otherwise(F.col("header_digest"))
    size = F.when(response, F.col("bytes_so_far")).otherwise(F.col("header_bytes"))
    return last.select("page_id", size.alias("payload_bytes"), digest.cast("string").alias("payload_digest"), "record_type", "refers_to", "url", "record_id")
