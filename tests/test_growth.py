"""Steps that grew faster than their input: what they hold and move stays in proportion, and results are the same."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkann.functions.vectors import dot
from sparkann.operators import cluster, evaluate, graph, knn, layout, pir, ring, search
from sparkann.plans import queries


def drawn(spark, n=200, d=4, high=4, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(int(i), [int(x) for x in rng.integers(-high, high, d)]) for i in rng.permutation(n)], "node_id long, vec array<smallint>")


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_graph_by_cells_without_the_driver(spark, monkeypatch, metric):
    def refuse(*_, **__):
        raise AssertionError("rows through the driver")

    v = drawn(spark).cache()
    rows = {r.node_id: np.array(r.vec, int) for r in v.collect()}
    want = set()
    for q, a in rows.items():
        dist = sorted((-int(a @ b) if metric == "ip" else int(((a - b) ** 2).sum()), i) for i, b in rows.items() if i != q)
        want |= {(q, slot, i, float(d)) for slot, (d, i) in enumerate(dist[:5])}
    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    monkeypatch.setattr(knn, "LEAST", 30)
    monkeypatch.setattr(knn, "PACK", 16)
    got = [tuple(r) for r in knn.knn_graph(v, 5, metric).collect()]
    assert len(got) == 1000 and set(got) == want  # many ties, which fall to smaller ids across cells


def test_cells_stay_bounded():
    for queries, base in ((615_384, 615_384), (6_153, 615_384), (10_000_000, 10_000_000)):
        q, b = knn.grid(queries, base, knn.BLOCK, knn.BASE, 96)
        assert queries / q <= knn.BLOCK and base / b <= knn.BASE and q * b >= 96
    assert knn.grid(20, 500, knn.BLOCK, knn.BASE, 96) == (1, 1)


def test_vectors_that_are_not_finite_take_no_part(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [float("inf"), 0.0]), (3, [float("nan"), 0.0])], "node_id long, vec array<double>")
    q = v.select(F.col("node_id").alias("qid"), "vec")
    assert [(r.qid, r.node_id, r.dist) for r in knn.exact_topk(q, v, 1, "ip").orderBy("qid").collect()] == [(0, 1, -2.0), (1, 0, -2.0)]


def test_search_keeps_the_best_of_a_cluster_and_finds_the_same(spark, monkeypatch):
    """Before, every member of a fetched cluster stayed in the state of every query."""
    q = drawn(spark, 240, 6, 60).withColumn("cluster", (F.col("node_id") % 3).cast("int")).withColumnRenamed("vec", "qvec").cache()
    laid = layout.layout(q.select("node_id", "cluster"), 8).cache()
    vectors = q.select("node_id", F.col("qvec").alias("vec"))
    edges = knn.knn_graph(vectors, 4, "ip").cache()
    centres = cluster.centroids(q.select("node_id", "cluster", F.col("qvec").alias("vec"))).cache()
    asked = q.where("node_id < 6").select(F.col("node_id").alias("qid"), "qvec").cache()
    members = laid.join(q.select("node_id", "qvec"), "node_id")
    states = []
    monkeypatch.setattr(search, "MEMBERS", 32)
    monkeypatch.setattr(search, "results", lambda state, ef, f=search.results: states.append(state) or f(state, ef))

    def whole(pairs, round_):
        held = pairs.join(asked.select("qid", F.col("qvec").alias("q")), "qid").join(members, "cluster")
        return held.select("qid", "new_id", "cluster", "sg_col", (-dot("q", "qvec", "long")).alias("dist"))

    config = search.SearchConfig(rounds=2, results_per_cluster=5, prune=False)
    run = lambda scorer: [sorted(map(tuple, x.collect())) for x in search.routed_search(asked, laid, q.select("node_id", "qvec"), edges, centres, 5, 20, config, scorer)]
    found, stats = run(None)
    scored = sum(r[4] for r in stats)
    assert scored > 6 * 80 and states[-1].count() < scored / 2
    assert [found, stats] == run(whole)


def test_ranks_by_label_are_those_of_all_relevant_pairs(spark):
    a = spark.createDataFrame([(i, [0, 0, 0, 1, 1, 2][i % 6] if i else 3) for i in range(30)], "node_id long, cluster int")
    asked = a.where("node_id % 5 = 0").select(F.col("node_id").alias("qid"))
    rng = np.random.default_rng(2)
    results = spark.createDataFrame([(q, r + 1, int(n)) for q in range(0, 30, 5) for r, n in enumerate(rng.permutation(30)[:6])], "qid long, rank int, node_id long")
    relevant = a.join(a.join(asked, F.col("node_id") == F.col("qid")).select("qid", "cluster"), "cluster").where("qid <> node_id").select("qid", "node_id")
    for k in (1, 3, 6):
        assert sorted(map(tuple, evaluate.label_ranks(results, a, asked, k).collect())) == sorted(map(tuple, evaluate.reciprocal_ranks(results, relevant, k).collect()))


def test_relevant_pairs_are_not_made(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all pairs of a label")

    monkeypatch.setattr(evaluate, "reciprocal_ranks", refuse)
    assert queries.qrels_mrr(spark, "/root/testdata/sf0.001").count() == 5


def test_traffic_needs_no_graph(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a graph for sizes alone")

    monkeypatch.setattr(queries, "edges", refuse)
    assert queries.comm_cost(spark, "/root/testdata/sf0.001").count() == 6


def test_products_by_halves_wrap():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(1 << 31), 1 << 32, (70, 60)), rng.integers(0, 1 << 32, (60, 40), dtype=np.uint32)
    assert (ring.multiply(a, b) == ((a.astype(object) @ b.astype(object)) % (1 << 32)).astype(np.uint32)).all()


def test_private_columns_by_blocks(spark, monkeypatch):
    """Before, each cell met every query, and the queries were made and held by the driver."""

    def refuse(*_):
        raise AssertionError("a query in the driver")

    monkeypatch.setattr(pir, "QUERIES", 5)
    monkeypatch.setattr(pir.NeighbourScheme, "query", refuse)
    sizes = layout.Shape(0, 3, 40, 4, 3)  # 30 columns
    rng = np.random.default_rng(5)
    held = {(int(c), int(r)): int(v) for c, r, v in zip(rng.choice([*range(7), *range(14, 30)], 200), rng.integers(0, sizes.rows, 200), rng.integers(0, 127, 200), strict=True)}
    cells = spark.createDataFrame([(c, r, v) for (c, r), v in held.items()], "sg_col int, row int, value int")
    scheme = pir.NeighbourScheme(sizes, n=16, block=7)
    got = pir.private_columns(cells, scheme, spark.range(30).select(F.col("id").alias("ct"), (29 - F.col("id")).alias("column")), seed=1).collect()
    assert len(got) == 30 * sizes.rows and all(r.value == held.get((29 - r.ct, r.place), 127) for r in got)
    own, noise = ring.secret(16, 9), ring.gaussian(30, 4)
    monkeypatch.undo()
    blocks = list(scheme.queries(np.array([11]), own[:, None], noise[:, None]))
    assert (np.concatenate(blocks)[:, 0] == scheme.query(11, own, 4)).all()


def test_beam_is_as_wide_as_a_sample_needs(spark):
    """Random directions, few edges: the width that is asked for finds under nine tenths."""
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=24)]) for i in range(1500)], "node_id long, vec array<double>").cache()
    nodes, edges = graph.build_graph(v, m=3, ef_construction=16)
    q = v.where("node_id % 50 = 0").select(F.col("node_id").alias("qid"), "vec")
    truth = knn.exact_topk(q, v, 10).cache()
    recall = lambda ef: evaluate.recall(graph.graph_search(q, v, nodes, edges, 10, ef, exclude_self=True), truth, 10).first()["recall"]
    ef = graph.wide_enough(v, nodes, edges, 10, 16)
    assert ef > 16 and recall(16) < 0.9 <= recall(ef)
