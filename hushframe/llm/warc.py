"""WARC archives: one gzip member per record, written in shards and read sequentially.

Writing.  Payload digests are taken first; only digests that several pages share go
on to the join that turns later copies into revisit records.  Each task writes its
rows to archive files of about ``FILE_BYTES`` in the shared folder and returns the
files' names and record counts; a name holds the task attempt, so a repeated attempt
never touches another's files and only the names of successful attempts are kept.

Reading.  A file is streamed: bytes go through one zlib decompressor per gzip member,
the header block is read up to its blank line, and Content-Length frames the block,
which is digested as it passes.  Memory is bounded by the read buffer, whatever a
record's size.  A member that does not end with its record, a wrong length, or a
digest that differs from the header is an error.

Files are opened through pyarrow's file systems, so the shared folder can be a local
or network mount, HDFS or an object store.

Defined results: a null payload is empty; rows that repeat a page id and payload are
all responses if that id is the smallest; a null page id counts as the largest, and a
group with null ids only has responses only; ids may be of any type that has an order
and is its own text (numbers, strings without line breaks): read() gives them back as
``key_type``; an empty table gives no files and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.shared import cut, new_path

FILE_BYTES = 64 << 20
READ_BYTES = 1 << 16
LEVEL = 6
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URLs, RFC 4122


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def one_line(value: str) -> str:
    """A header value: no line breaks or controls."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP header only."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {one_line(url)}"] if url else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class Members:
    """The gzip members of a stream, each as an iterator of decompressed pieces."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while self.rest or self._more():
            yield self._pieces()

    def _more(self) -> bool:
        self.rest = self.stream.read(READ_BYTES)
        return bool(self.rest)

    def _pieces(self) -> Iterator[bytes]:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not self.rest and not self._more():
                raise ValueError("a gzip member is cut short")
            piece = unpack.decompress(self.rest, READ_BYTES)
            self.rest = unpack.unconsumed_tail or unpack.unused_data
            if piece:
                yield piece
            # Output that the size limit held back comes before more input.
            while not unpack.eof and not self.rest and (piece := unpack.decompress(b"", READ_BYTES)):
                yield piece


def read_records(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive, in order: header fields (lower-case names), n_payload, sha1 of the payload, payload if asked for."""
    for pieces in Members(stream):
        held = bytearray()
        while b"\r\n\r\n" not in held:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("a record has no end of header")
            held += piece
        head, _, body = bytes(held).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(out["content-length"])
        block, payload, http, n, kept, tail = hashlib.sha1(), hashlib.sha1(), bytearray(), 0, [], b""
        in_http = True
        while True:
            part, extra = body[:left], body[left:]
            left -= len(part)
            tail += extra
            block.update(part)
            if in_http and part:
                http += part
                if b"\r\n\r\n" in http:
                    part, in_http = bytes(http).partition(b"\r\n\r\n")[2], False
                else:
                    part = b""
            payload.update(part)
            n += len(part)
            if payloads:
                kept.append(part)
            body = next(pieces, None)
            if body is None:
                break
        if left or tail != b"\r\n\r\n" or in_http:
            raise ValueError("a record's length is wrong")
        digests = {"warc-block-digest": block} | ({"warc-payload-digest": payload} if out["warc-type"] != "revisit" else {})
        for name, found in digests.items():
            if out[name] != "sha1:" + base64.b32encode(found.digest()).decode():
                raise ValueError(f"{name} differs")
        out["n_payload"] = n if out["warc-type"] != "revisit" else int(next(x for x in bytes(http).lower().split(b"\r\n") if x.startswith(b"content-length:"))[15:])
        if payloads:
            out["payload"] = b"".join(kept)
        yield out


def filesystem(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def with_revisits(pages: DataFrame, *, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """The pages' columns, hushframe_revisit boolean and hushframe_refers_to (the smallest key among equal payloads)."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    keyed = pages.withColumns({"hushframe_sha1": F.unhex(F.sha1(body))})
    small = keyed.where(F.octet_length(body) >= least_bytes) if least_bytes else keyed
    groups = small.groupBy("hushframe_sha1").agg(F.min(f"`{key}`").alias("hushframe_refers_to"), F.count("*").alias("n"))
    shared = cut(groups.where("n > 1 and hushframe_refers_to is not null").drop("n"), "shared_payloads")
    joined = keyed.join(shared, "hushframe_sha1", "left")
    revisit = F.coalesce(F.col("hushframe_refers_to").isNotNull() & ~F.col(f"`{key}`").eqNullSafe(F.col("hushframe_refers_to")), F.lit(False))
    return joined.withColumn("hushframe_revisit", revisit).drop("hushframe_sha1")


def write(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives; the table of (uri string, n_records long, n_bytes long) that were written, one row a file."""
    spark = pages.sparkSession
    top = new_path(spark, "warc")
    rows = with_revisits(pages, key=key, payload=payload, least_bytes=least_bytes)
    rows = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("body"), "hushframe_revisit", "hushframe_refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        system, path = filesystem(top)
        out, done, n, size = None, [], 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            done.append((f"{top}/{stem}-{len(done):05}.warc.gz", n, size))
            out = None

        for batch in batches:
            for page, link, body, revisit, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system.create_dir(path, recursive=True)
                    out, n, size = system.open_output_stream(f"{path}/{stem}-{len(done):05}.warc.gz", compression=None), 0, 0
                raw = record(page, link, body, target, revisit)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= file_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], type=pa.string()), pa.array([x[1] for x in done], type=pa.int64()), pa.array([x[2] for x in done], type=pa.int64())], names=["uri", "n_records", "n_bytes"])

    return cut(rows.mapInArrow(run, "uri string, n_records long, n_bytes long"), "warc_files")


def read(files: DataFrame, key_type: str = "long") -> DataFrame:
    """The records of all files, read sequentially and verified, one task for each few files; with payloads, see read_records()."""
    schema = "uri string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = filesystem(uri)
                seen, rows = 0, []
                with system.open_input_stream(path, compression=None) as stream:
                    for x in read_records(stream):
                        rows.append((uri, x.get("x-page-id"), x["n_payload"], x["warc-payload-digest"].removeprefix("sha1:"), x["warc-type"], x.get("x-refers-to-page-id")))
                        seen += 1
                        if len(rows) == 8192:
                            yield arrow(rows)
                            rows = []
                if seen != expected:
                    raise ValueError(f"{uri} has {seen} records, not {expected}")
                yield arrow(rows)

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], type=t) for i, t in enumerate(kinds)], names=["uri", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, files.count())
    rows = files.select("uri", "n_records").repartitionByRange(n, "uri").mapInArrow(run, schema)
    return rows.withColumns({x: F.col(x).cast(key_type) for x in ("page_id", "refers_to")})


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record, as the archives that were written give it back."""
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
