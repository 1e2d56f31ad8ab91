"""WARC archives with records compressed against an embedded Zstandard dictionary (operator 8).

Each task writes its pages to archives of bounded size. An archive begins with a skippable frame (magic 0x184D2A5D) that
holds a dictionary, trained from the first records of that archive, SAMPLE_BYTES at most; every record after it is one
Zstandard frame of its own, so that a reader can start at any record. Records with equal payloads are found by SHA-1:
the least page_id of each payload keeps it in a response record, the others are revisit records that refer to it. Only
digests are grouped, with partial minima, and joined back; a payload that many pages share is a row for each task.

Archives go to the folder that all executors share (spark.checkpoint.dir, unless named), under a temporary name until they
are complete: a task that runs again replaces its own archives with equal ones.

Defined results: null html is an empty payload; a null url gives a record without target; a carriage return, line feed or
nul byte in a url is percent-encoded; payloads shorter than min_payload bytes are all responses; rows that repeat both
page_id and payload of a response are responses too; a null page_id is a revisit where its payload has any page_id, else
a response; an empty table gives no archive. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkann.llm.common import scratch_dir, text_bytes, written

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 1 << 20
ARCHIVE_BYTES = 128 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A").replace("\0", "%00")))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("X-Payload-Length", len(payload))]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", refers_to)]
    block = HTTP if revisit else HTTP + payload
    fields.append(("Content-Length", len(block)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or where there is too little to train on, the samples themselves as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def archive(path: str, records: list[bytes], rest: Iterator[bytes]) -> tuple[int, int]:
    """Write records, then what rest still gives until the archive is full. Returns records and uncompressed bytes."""
    fs, name = file_system(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    held = dictionary(records)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(held))
    n = size = 0
    with fs.open_output_stream(part := f"{name}.{uuid.uuid4().hex}.part", compression=None) as out:
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(held)) + held)
        for x in records:
            out.write(pack.compress(x))
            n, size = n + 1, size + len(x)
        while size < ARCHIVE_BYTES and (x := next(rest, None)) is not None:
            out.write(pack.compress(x))
            n, size = n + 1, size + len(x)
    fs.move(part, name)
    return n, size


def archived(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    rows = zip(part["page_id"].to_pylist(), part["url"].to_pylist(), text_bytes(part["html"]), part["first"].to_pylist(), part["revisit"].to_pylist(), strict=True)
                    yield from (record(*x) for x in rows)

        source, task, seq = records(), TaskContext.get().partitionId(), 0
        while True:
            samples, size = [], 0
            while size < SAMPLE_BYTES and (x := next(source, None)) is not None:
                samples.append(x)
                size += len(x)
            if not samples:
                return
            path = f"{folder}/{task:06d}-{seq:06d}.warc.zst"
            n, size = archive(path, samples, source)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
            seq += 1

    return run


def write_warc(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Archive pages (page_id, url, html). Returns path, records and uncompressed bytes of each archive."""
    spark = pages.sparkSession
    folder = folder or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    slim = slim.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    same = slim.where(F.octet_length("html") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = written(same.where("n > 1 and first is not null").select("digest", "first"), "payloads")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = slim.join(same, "digest", "left").withColumn("revisit", revisit).select("page_id", "url", "html", "first", "revisit")
    return written(marked.mapInArrow(archived(folder), "path string, records long, bytes long"), "archives")


def frames(path: str) -> Iterator[bytes]:
    """Uncompressed records of an archive, one after another."""
    fs, name = file_system(path)
    with fs.open_input_stream(name, compression=None) as file:
        magic, size = struct.unpack("<II", file.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{path} doesn't begin with a dictionary frame")
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(file.read(size)))
        rest = b""
        while rest or (rest := file.read(1 << 20)):
            one, found = unpack.decompressobj(), []
            while not one.eof:
                if not rest and not (rest := file.read(1 << 20)):
                    raise ValueError(f"{path} ends within a record")
                found.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
            yield b"".join(found)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block[len(HTTP) :]


def unarchived(with_payload: bool):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def row(path: str, data: bytes) -> tuple:
        fields, payload = parsed(data)
        kind, digest, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        if kind == "response" and (len(payload) != n or base32_sha1(payload) != digest):
            raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} isn't what was archived")
        number = lambda x: int(fields[x]) if x in fields else None
        return (number("X-Page-ID"), fields.get("WARC-Target-URI"), kind, number("X-Refers-To-Page-ID"), n, digest, payload)[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows: list[tuple] = []
                for data in frames(path):
                    rows.append(row(path, data))
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read archives (column path) back, one row per record. Payloads of responses are held against their digests; a
    revisit has no payload of its own (empty), its length and digest are those of the response."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    paths = archives.select("path").repartition(max(1, archives.count()), "path")
    return paths.mapInArrow(unarchived(with_payload), schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
SQL = {
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex,
             min(page_id) OVER (PARTITION BY sha1(payload)) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, ((i // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h"""
}
