import struct

import numpy as np
import pytest

from sparkann.functions.quantizer import Quantizer
from sparkann.sources import tables, vecs


def put(path, rows, code):
    with open(path, "wb") as out:
        for r in rows:
            out.write(struct.pack("<i", len(r)) + np.array(r, code).tobytes())
    return str(path)


@pytest.mark.parametrize("kind, code", [("fvecs", "<f4"), ("ivecs", "<i4"), ("bvecs", "u1")])
def test_read(spark, tmp_path, kind, code):
    rows = [[i, i + 1, 200 - i] for i in range(10)]
    df = vecs.read_vecs(spark, put(tmp_path / f"a.{kind}", rows, code))
    assert [(r.id, list(r.vec)) for r in df.orderBy("id").collect()] == [(i, r) for i, r in enumerate(rows)]
    assert vecs.read_vecs(spark, str(tmp_path / f"a.{kind}"), rows=4).count() == 4


def test_parts_of_a_file(spark, tmp_path, monkeypatch):
    path = put(tmp_path / "a.fvecs", [[i, 0.5] for i in range(100)], "<f4")
    reader = vecs.VecsReader(path, "fvecs", None)
    monkeypatch.setattr(vecs, "PART_BYTES", 120)
    parts = reader.partitions()
    assert len(parts) == 10
    assert [int(x[0]) for p in parts for b in reader.read(p) for x in b["vec"].to_pylist()] == list(range(100))


def test_what_cannot_be_read(spark, tmp_path):
    good = put(tmp_path / "a.fvecs", [[1, 2]], "<f4")
    (tmp_path / "cut.fvecs").write_bytes(open(good, "rb").read()[:-2])
    put(tmp_path / "ragged.fvecs", [[1, 2, 3], [1, 2, 3]], "<f4")
    data = bytearray((tmp_path / "ragged.fvecs").read_bytes())
    data[16:20] = struct.pack("<i", 2)
    (tmp_path / "ragged.fvecs").write_bytes(data)
    (tmp_path / "zero.fvecs").write_bytes(struct.pack("<i", 0))
    (tmp_path / "empty.fvecs").write_bytes(b"")
    for name in ("cut", "ragged", "zero"):
        with pytest.raises(Exception):
            vecs.read_vecs(spark, str(tmp_path / f"{name}.fvecs")).collect()
    assert vecs.read_vecs(spark, str(tmp_path / "empty.fvecs")).count() == 0
    with pytest.raises(ValueError):
        vecs.kind_of("x", "hdf5")


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([([float(i), -0.5],) for i in range(50)], "vec array<float>").repartition(3)
    vecs.write_vecs(df, str(tmp_path / "out.fvecs"))
    vecs.write_vecs(df.limit(5), str(tmp_path / "out.fvecs"))
    back = vecs.read_vecs(spark, str(tmp_path / "out.fvecs"))
    assert sorted(r.vec[0] for r in back.collect()) == sorted([*map(float, range(50)), *(r.vec[0] for r in df.limit(5).collect())])
    assert sorted(r.id for r in back.collect()) == list(range(55))
    vecs.write_vecs(df.limit(2), str(tmp_path / "out.fvecs"), mode="overwrite")
    assert vecs.read_vecs(spark, str(tmp_path / "out.fvecs")).count() == 2


def test_text_tables(spark, tmp_path):
    (tmp_path / "qrels.tsv").write_text("3 0 17 1\n3\t0\t18\t0\n\n1 0 5 2\n")
    assert sorted(map(tuple, tables.read_qrels(spark, str(tmp_path / "qrels.tsv")).collect())) == [(1, 5, 2), (3, 17, 1)]
    (tmp_path / "q.tsv").write_text("7\ttext with\ttab\n2\té\nno tab\n")
    assert sorted(map(tuple, tables.read_texts(spark, str(tmp_path / "q.tsv"), "qid").collect())) == [(2, "é"), (7, "text with\ttab")]
    ids = spark.createDataFrame([(i,) for i in (30, 10, 20, 10, None)], "pid long")
    assert sorted(map(tuple, tables.id_map(ids, "pid").collect())) == [(10, 0), (20, 1), (30, 2)]
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert sorted((r.id, list(r.vec)) for r in tables.embed(texts, lambda xs: [[len(x), 1] for x in xs]).collect()) == [(1, [2, 1]), (2, [0, 1])]


def test_index_and_stages(spark, tmp_path):
    path, made = str(tmp_path / "index"), []
    layout = spark.createDataFrame([(1, 0)], "node_id long, new_id long")
    with pytest.raises(ValueError):
        tables.load_index(spark, path)
    with pytest.raises(ValueError):
        tables.save_index(path, Quantizer(scale=2.0), "ip", nothing=layout)
    tables.save_index(path, Quantizer(scale=2.0), "ip", layout=layout)
    q, metric, held = tables.load_index(spark, path)
    assert q.scale == 2.0 and metric == "ip" and held["layout"].collect() == layout.collect()
    layout.withColumnRenamed("new_id", "other").write.mode("overwrite").parquet(f"{path}/layout")
    with pytest.raises(ValueError):
        tables.load_index(spark, path)
    make = lambda: made.append(1) or layout
    for key in ("a", "a", "b"):
        assert tables.stage(spark, str(tmp_path / "stage"), make, key).count() == 1
    assert len(made) == 2
    text = tables.write_report(layout, str(tmp_path / "report"), {"recall": 0.5, "queries": 3})
    assert "recall" in text and spark.read.parquet(str(tmp_path / "report" / "stats")).count() == 1


def test_stream_append(spark, tmp_path):
    from sparkann.streaming.append import append_stream, assigned, counts_by_cluster

    rows = spark.createDataFrame([(i, [1.0 if i % 2 else -1.0, 0.1]) for i in range(20)], "node_id long, vec array<float>")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    q, centres = Quantizer(scale=127.0), [(0, [-127.0, 0.0]), (1, [127.0, 0.0])]
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), q, centres).awaitTermination(120)
    got = sorted((r.node_id, r.cluster, list(r.qvec)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.node_id, r.cluster, list(r.qvec)) for r in assigned(rows, q, centres).collect())
    assert [c for i, c, _ in got] == [i % 2 for i in range(20)]
    events = spark.readStream.format("rate").load().selectExpr("timestamp AS ts", "CAST(value % 2 AS INT) AS cluster")
    assert counts_by_cluster(events).isStreaming
