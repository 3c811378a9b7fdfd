"""WARC archives through a chunked record table.

A payload never travels whole through Python: the writer gets rows of (record, chunk number, chunk), in order and without
a shuffle since a row's chunks stay where the row is, and streams each into one gzip member of its task's archive. The
reader streams the archives and gives a chunk table: record identifier, chunk number, the bytes, and digests carried
forward (`digest_so_far` of chunk k is the SHA-1 of the payload up to its end; that of the last chunk is the record's).

Archives lie in a folder that all machines share; each task attempt writes a file of its own and only those that the index
of finished tasks names are read, so a lost executor leaves nothing that counts.

Of records with equal payloads of at least `least` bytes, the one with the smallest id is the response and the others
revisit it; smaller ones are all responses.

Defined cases: null payloads are empty; a null id is written as an empty one and counts as larger than any other; repeated
rows (same id and payload) are written each, all responses if they hold the smallest id; a null target address is left
out; control characters in it are percent-encoded; an empty table gives no archive and an empty table back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK_TABLE = (
    "file string, page_id long, record_type string, refers_to long, target_uri string, stated_digest string, "
    "chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean"
)
_PA = pa.schema(
    [
        *((n, t) for n, t in (("file", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()))),
        *((n, t) for n, t in (("stated_digest", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()))),
        *((n, t) for n, t in (("digest_so_far", pa.string()), ("last", pa.bool_()))),
    ]
)
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("page_id", pa.int64())])


def with_duplicates(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, payload_hex (SHA-1), payload_bytes and refers_to (null for responses) of every page.

    The join on the digest is skewed if one payload is common; the large side is the left one, which Spark splits.
    """
    df = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    df = df.withColumn("payload_hex", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = df.groupBy("payload_hex").agg(F.min("page_id").alias("first_id"))
    df = df.join(first, "payload_hex", "left")
    later = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return df.withColumn("refers_to", F.when(later, F.col("first_id"))).drop("first_id")


def chunked(records: DataFrame, chunk_bytes: int) -> DataFrame:
    """The chunk rows of the records; a revisit has one empty chunk."""
    payload = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    df = records.withColumn("payload", payload)
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / F.lit(chunk_bytes))).cast("int")
    df = df.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"), (count - 1).alias("last_no"))
    piece = F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")
    return df.select("page_id", "url", "payload_hex", "payload_bytes", "refers_to", "chunk_no", "last_no", piece.alias("chunk"))


def _head(row: dict, date: str) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    revisit, digest = row["refers_to"] is not None, base64.b32encode(bytes.fromhex(row["payload_hex"])).decode()
    block = len(HTTP) + (0 if revisit else row["payload_bytes"])
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(row['page_id'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in row["url"]))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(row['refers_to'])}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP


def write(records: DataFrame, path: str, chunk_bytes: int = 1 << 16, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the records to gzipped archives under the address `path`; returns their index: file, offset, size, page_id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        file, out, at, start, packer, index = "", None, 0, 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(folder)
                    file = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{folder}/{file}")
                if row["chunk_no"] == 0:
                    packer, start = zlib.compressobj(6, zlib.DEFLATED, 31), at
                    at += out.write(packer.compress(_head(row, date))) or 0
                at += out.write(packer.compress(row["chunk"]))
                if row["chunk_no"] == row["last_no"]:
                    at += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    index.append((file, start, at - start, row["page_id"]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), _INDEX.types, strict=True)], schema=_INDEX)

    return written(chunked(records, chunk_bytes).mapInArrow(task, "file string, offset long, size long, page_id long"), "warc-index")


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _chunks(file: str, stream, chunk_bytes: int, data: bool) -> Iterator[tuple]:
    """The chunk rows of one archive."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            head: dict[str, str] = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(":")
                head[name.lower()] = value.strip()
            left = int(head["content-length"])
            while left > 0 and (line := f.readline()):  # the HTTP head
                left -= len(line)
                if line == b"\r\n":
                    break
            same = (file, _number(head["warc-record-id"]), head["warc-type"], _number(head.get("warc-refers-to")), head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha1:"))
            sha, no, done = hashlib.sha1(), 0, 0
            while True:
                piece = f.read(min(left - done, chunk_bytes))
                sha.update(piece)
                done += len(piece)
                over = done >= left or not piece
                yield (*same, no, piece if data else None, done, base64.b32encode(sha.digest()).decode(), over)
                no += 1
                if over:
                    break


def read_chunks(spark, path: str, files: DataFrame, chunk_bytes: int = 1 << 16, data: bool = True) -> DataFrame:
    """The chunk table of the archives under `path` that `files` (column `file`) names; without `data` only the digests."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{folder}/{file}") as stream:
                    for row in _chunks(file, stream, chunk_bytes, data):
                        rows.append(row)
                        held += len(row[7] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PA.types, strict=True)], schema=_PA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PA.types, strict=True)], schema=_PA)

    names = files.select("file").distinct()
    # a task for each archive: the names are a few bytes, so Spark would read them all in one
    return names.repartition(max(1, min(names.count(), 100_000))).mapInArrow(task, CHUNK_TABLE)


def records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and digest_ok of every record in a chunk table.

    A response's figures are those of the bytes read; a revisit has them from the response that it refers to.
    """
    ends = chunks.filter("last").select("page_id", "record_type", "refers_to", "stated_digest", "bytes_so_far", "digest_so_far")
    ends = written(ends, "warc-records")
    origin = ends.filter("record_type = 'response'").groupBy(F.col("page_id").alias("o_id"), F.col("digest_so_far").alias("o_digest"))
    origin = origin.agg(F.max("bytes_so_far").alias("o_bytes"))
    df = ends.join(origin, (ends.refers_to == origin.o_id) & (ends.stated_digest == origin.o_digest), "left")
    own = F.col("record_type") == "response"
    return df.select(
        "page_id",
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("o_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("o_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        (F.when(own, F.col("digest_so_far")).otherwise(F.col("o_digest")) == F.col("stated_digest")).alias("digest_ok"),
    )
