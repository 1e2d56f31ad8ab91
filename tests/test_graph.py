import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkann.operators import evaluate, graph, knn, layout


def vectors(spark, n=300, d=6, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.integers(-20, 20, d)]) for i in range(n)], "node_id long, vec array<double>")


def brute(rows, qids, k, metric):
    out = set()
    for q in qids:
        dist = []
        for i, v in rows.items():
            if i != q:
                dist.append((-float(np.dot(rows[q], v)) if metric == "ip" else float(((rows[q] - v) ** 2).sum()), i))
        out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(sorted(dist)[:k])}
    return out


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_exact_topk(spark, metric):
    v = vectors(spark).repartition(5)
    rows = {r.node_id: np.array(r.vec) for r in v.collect()}
    q = v.where("node_id < 20").select(F.col("node_id").alias("qid"), "vec")
    for block in (4096, 7, 1):  # one plan, several blocks, more blocks than one plan holds
        got = {tuple(r) for r in knn.exact_topk(q, v, 5, metric, block=block).collect()}
        assert got == brute(rows, range(20), 5, metric)


def test_topk_ties_nulls_and_few_rows(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)] + [(9, None), (10, [None, 1.0])], "node_id long, vec array<double>")
    q = spark.createDataFrame([(3, [1.0, 0.0])], "qid long, vec array<double>")
    assert [r.node_id for r in knn.exact_topk(q, v, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert knn.exact_topk(q, v, 99).count() == 5
    assert knn.exact_topk(q.limit(0), v, 3).collect() == [] and knn.exact_topk(q, v.limit(0), 3).collect() == []


def test_diversity():
    dist = np.array([1.0, 1.1, 5.0])
    between = np.array([[0, 0.1, 9], [0.1, 0, 9], [9, 9, 0]])
    assert graph.diverse(dist, between, 2) == [0, 2]  # the second is nearer to the first than to the node
    assert graph.diverse(dist, between, 3) == [0, 2, 1]


def test_built_graph(spark):
    v = vectors(spark, 400)
    nodes, edges = graph.build_graph(v, m=6, ef_construction=40)
    assert nodes.count() == 400
    per = edges.groupBy("level", "node_id").agg(F.count("*").alias("n")).groupBy("level").agg(F.max("n").alias("n")).collect()
    assert all(r.n <= (12 if r.level == 0 else 6) for r in per)
    assert edges.where("node_id = nbr").count() == 0
    q = v.where("node_id % 10 = 0").select(F.col("node_id").alias("qid"), "vec")
    truth = knn.exact_topk(q, v, 10)
    found = graph.graph_search(q, v, nodes, edges, 10, 64, exclude_self=True)
    assert evaluate.recall(found, truth, 10).first()["recall"] >= 0.9


def test_symmetric_and_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 1), (5, 77)], "node_id long, nbr long")
    nodes = spark.createDataFrame([(i, int(i > 2)) for i in range(1, 6)], "node_id long, level int")
    assert {tuple(r) for r in graph.symmetric(e).collect()} == {(1, 2), (2, 1), (1, 4), (4, 1), (5, 77), (77, 5)}
    assert graph.valid(e, nodes).count() == 4
    assert {r.nbr for r in graph.at_level(e, nodes, 1).collect()} == {3}


def test_bfs_order():
    near = {1: [2, 3], 2: [1], 3: [1, 4], 4: [3], 7: [8], 8: [7], 9: [100]}
    assert graph.bfs_order([1, 2, 3, 4, 7, 8, 9], near) == [1, 2, 3, 4, 7, 8, 9]


def test_layout_is_a_bijection(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(20)], "node_id long, cluster int")
    e = spark.createDataFrame([(i, s, (i + 3 * (s + 1)) % 20) for i in range(20) for s in range(3)], "node_id long, slot int, nbr long")
    laid = layout.layout(a, 4, graph.cluster_bfs(a, e))
    rows = laid.collect()
    assert sorted(r.new_id for r in rows) == list(range(20))
    assert {(r.cluster, r.lo, r.hi) for r in layout.offsets(a).collect()} == {(0, 0, 7), (1, 7, 14), (2, 14, 20)}
    for r in rows:
        assert (r.subgroup, r.idx_in_sg) == divmod(r.local_idx, 4) and r.sg_col == r.cluster * 2 + r.subgroup
    sizes = layout.shape(laid, 4, 3)
    assert (sizes.nodes, sizes.clusters, sizes.largest_cluster, sizes.subgroups_per_cluster) == (20, 3, 7, 2)
    decoded = {(r.new_id, r.slot, r.nbr_id) for r in layout.decoded_neighbours(layout.encoded_neighbours(e, laid, sizes), layout.offsets(laid), sizes).collect()}
    new = {r.node_id: r.new_id for r in rows}
    assert decoded == {(new[r.node_id], r.slot, new[r.nbr]) for r in e.collect()}
    stats = layout.group_stats(e, laid).first()
    assert stats["edges"] == 60
    groups = layout.neighbour_groups(e, laid).collect()
    assert sum(len(g.local_indices) for r in groups for g in r.groups) == 60
    assert all([(g.cluster, g.subgroup) for g in r.groups] == sorted((g.cluster, g.subgroup) for g in r.groups) for r in groups)


def test_all_pairs_of_an_oversized_cell_meet(spark):
    dealt = graph.in_cells(vectors(spark, 300), "l2", probes=1, cell=40).select("node_id", "cell", "split").collect()
    cells, splits = {}, {}
    for r in dealt:
        cells.setdefault(r.cell, set()).add(r.node_id)
        splits.setdefault((r.cell, r.split), set()).add(r.node_id)
    assert max(map(len, cells.values())) > 40 and len(cells) > 1
    met = {(a, b) for own in splits.values() for a in own for b in own}
    assert all((a, b) in met for own in cells.values() for a in own for b in own)
