from collections import defaultdict

import corpus_pipeline
from sparkann.llm.common import written
from sparkann.llm.simhash import fingerprint
from tests.llm import cases


def test_stages_take_effect(spark, tmp_path):
    passage = " ".join(f"shared{i}" for i in range(80))
    copy = " ".join(f"word{i * 7 % 101}x{i}" for i in range(120))
    apart = lambda t: (fingerprint(t.encode()) ^ fingerprint(copy.encode())).bit_count()
    near_copy = next(t for i in range(1000) if 0 < apart(t := copy.replace("word0x0 ", f"word0x{i}y ")) <= 3)
    own = lambda k: " ".join(f"own{k}w{i}" for i in range(70))
    source = [(1, copy, "en"), (2, copy, "en"), (3, near_copy, "en"), (4, own(4) + " " + passage, "en"), (5, passage + " " + own(5), "fr"), (6, own(6) + " mail me at jo.do@example.org now", "en"), (7, "too short", "en"), (8, "the same " * 60, "en"), (None, own(9), None), (10, None, "en")]
    folder = cases.folder(spark, tmp_path, source, [(1, 1, 0)])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
        seen.append((name, docs))
    quality, near, suffix, pii, packed = (d for _, d in seen)
    for d in (quality, near, suffix, pii):
        assert d.columns == columns
    assert {r.doc_id for r in quality.collect()} == {1, 2, 3, 4, 5, 6, None}
    assert sorted((r.doc_id for r in near.collect()), key=str) == sorted([1, 4, 5, 6, None], key=str)
    cut = {r.doc_id: r.text for r in suffix.collect()}
    assert "shared40" not in cut[4] + cut[5] and "own4w60" in cut[4] and "own5w60" in cut[5] and cut[1] == copy
    masked = {r.doc_id: r.text for r in pii.collect()}
    assert "<EMAIL>" in masked[6] and "jo.do" not in masked[6] and masked[None] == own(9)
    lengths = defaultdict(int)
    for r in packed.collect():
        lengths[r.doc_id] += r.length
    assert set(lengths) == {1, 4, 5, 6, None}
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.select("doc_id", "piece", "ids_crc32").collect()), key=str) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()), key=str)


def test_empty_table(spark, tmp_path):
    folder = cases.folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
