import base64
import hashlib
import struct

import duckdb
import pytest
import zstandard

from sparkann.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first string"
ROWS = [
    (3, "http://a/3", "same", "d", "f"), (1, "http://a/1", "same", "d", "f"), (2, None, "same", "d", "f"), (4, "http://a/4\r\nX: y", None, "d", "f"),
    (5, "http://a/5", "", "d", "f"), (6, "http://é/6", "é🙂\r\n\r\nWARC/1.1\r\n\r\n" * 9, "d", "f"), (7, "", "x" * 3_000_000, None, None), (None, "http://n", "same", "d", "f"),
]


def expected(rows, least=0):
    first = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        revisit = b in first and first[b] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=str)


def read(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    archives = warc.write_warc(spark.createDataFrame(ROWS, SCHEMA).repartition(2), min_payload=least)
    back = warc.read_warc(archives)
    assert read(back) == expected(ROWS, least)
    kept = {r.page_id: bytes(r.payload) for r in back.collect() if r.record_type == "response"}
    assert all(kept[i] == (h or "").encode() for i, _, h, *_ in ROWS if i in kept)


def test_frames_stand_alone(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<html><body>page {i} " + "some words that repeat " * 40 + "</body></html>", None, None) for i in range(400)]
    path = warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path)).first().path
    data = open(path, "rb").read()
    magic, n = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == struct.pack("<I", 0xEC30A437)  # a trained dictionary
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    one = unpack.decompressobj()
    assert one.decompress(data[8 + n :]).startswith(b"WARC/1.1\r\nWARC-Type: response") and one.eof
    assert len(list(warc.frames(path))) == 400


def test_damage_is_noticed(tmp_path):
    path = f"{tmp_path}/a.warc.zst"
    warc.archive(path, [warc.record(1, "u", b"abc", None, False)], iter(()))
    data = bytearray(open(path, "rb").read())
    open(path, "wb").write(data[:-3])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(path))


def test_sql_agrees(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted((tuple(r) for r in con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.SQL['op8_warc']})").fetchall()), key=str)
    assert read(warc.op8_warc(spark, str(tmp_path))) == want


def test_empty(spark):
    archives = warc.write_warc(spark.createDataFrame([], SCHEMA))
    assert archives.collect() == [] and warc.read_warc(archives).collect() == []
