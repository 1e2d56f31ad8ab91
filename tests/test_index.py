import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkann.operators.knn import exact_topk
from sparkann.plans import index
from sparkann.sources.vecs import write_vecs


def test_build_search_and_report(spark, tmp_path):
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 1, (5, 8))
    rows = [(i, [float(x) for x in centre[i % 5] + rng.normal(0, 0.4, 8)]) for i in range(150)]
    write_vecs(spark.createDataFrame(rows, "node_id long, vec array<float>").orderBy("node_id").coalesce(1), str(tmp_path / "base.fvecs"))
    vectors = index.load_vectors(spark, str(tmp_path / "base.fvecs"))
    assert {r.node_id for r in vectors.collect()} == set(range(150))
    config = index.BuildConfig(m=6, ef_construction=32, clusters=5, subgroup=8, method="kmeans")
    report = index.build_index(vectors, str(tmp_path / "index"), config)
    assert report["nodes"] == 150 and report["clusters"] == 5 and report["ratio"] == 4
    again = index.build_index(vectors, str(tmp_path / "index"), config)  # goes on from whole stages
    assert again == report
    held = index.Index.open(spark, str(tmp_path / "index"))
    queries = vectors.where("node_id < 10").select(F.col("node_id").alias("qid"), "vec")
    found, stats = held.search(queries, 10, 50)
    q = held.tables["vectors"].select("node_id", F.col("qvec").alias("vec"))
    truth = exact_topk(q.where("node_id < 10").select(F.col("node_id").alias("qid"), "vec"), q, 10, "ip", exclude_self=False)
    out = held.report(found, stats, truth, str(tmp_path / "report"))
    assert out["recall"] >= 0.8 and out["mrr"] >= 0.9 and out["up_bytes"] > 0
    with pytest.raises(ValueError):
        held.search(spark.createDataFrame([(0, [1.0])], "qid long, vec array<float>"))


def test_prepare_texts(spark, tmp_path):
    texts = spark.createDataFrame([(10, "a"), (30, "bbb"), (20, "cc")], "id long, text string")
    made = []
    encoder = lambda xs: [[float(len(x)), 1.0] for x in xs]
    for _ in range(2):
        made.append(index.prepare_texts(spark, texts, texts.where("id < 30"), encoder, str(tmp_path / "t"), 2))
    truth = {(r.qid, r["rank"]): r.node_id for r in made[1]["truth"].collect()}
    assert truth == {(0, 1): 2, (0, 2): 1, (1, 1): 2, (1, 2): 1}
    assert {(r.id, r.idx) for r in made[0]["pid_to_index"].collect()} == {(10, 0), (20, 1), (30, 2)}
