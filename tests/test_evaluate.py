import pytest

from sparkann.operators import evaluate
from sparkann.operators.layout import Shape


def test_recall_and_mrr(spark):
    results = spark.createDataFrame([(1, 1, 2), (1, 2, 9), (1, 3, 3), (1, 4, 2), (2, 1, 8)], "qid long, rank int, node_id long")
    truth = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 7), (2, 2, 8), (2, 3, 9)], "qid long, rank int, node_id long")
    assert evaluate.recall(results, truth, 3).first()[:] == (2, 6, 3, 0.5)  # a node counts once
    assert evaluate.mrr(results, truth.where("qid = 1"), 3).first()[:] == (1, 1.0)
    assert {tuple(r) for r in evaluate.reciprocal_ranks(results, spark.createDataFrame([(1, 9), (2, 1), (3, 1)], "qid long, node_id long"), 3).collect()} == {(1, 0.5), (2, 0.0), (3, 0.0)}


def test_relevance_needs_id_maps(spark):
    qrels = spark.createDataFrame([(7, 70, 1), (7, 71, 0), (8, 80, 1)], "qid long, pid long, rel int")
    p = spark.createDataFrame([(70, 0), (80, 1)], "pid long, idx long")
    q = spark.createDataFrame([(7, 0), (8, 1)], "qid long, idx long")
    assert {tuple(r) for r in evaluate.relevance_by_id(qrels, p, q).collect()} == {(0, 0), (1, 1)}


def test_summary(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (10, 10.0)], "a long, b double")
    rows = {r.field: r[1:] for r in evaluate.summary(df, "a", "b").collect()}
    assert rows["a"] == rows["b"] == (4.0, 1.0, 10.0, 2.5)


def test_reports(spark):
    sizes = Shape(100, 4, 30, 8, 6)
    c = evaluate.communication(sizes, 16, 11, 10)
    assert c["up_bytes"] == 11 * 4 * 4 * 16 + 10 * 4 * sizes.columns and c["down_bytes"] == 11 * 4 * 30 + 10 * 4 * sizes.rows
    assert evaluate.index_report(10, 4)["ratio"] == 4 and evaluate.index_report(10, 4)["saving_percent"] == 75
    assert evaluate.moving_average([10, 20]) == pytest.approx(13)
    assert "queries" in evaluate.render({"queries": 3})
    df = spark.createDataFrame([(bytearray(b"abc"),)], "m binary")
    assert evaluate.message_bytes(df, "m").first()[0] == 3
    assert evaluate.describe(m=df)["m"] == {"rows": 1, "columns": {"m": "binary"}}
