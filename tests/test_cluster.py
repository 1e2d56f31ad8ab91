import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkann.operators import cluster


def blobs(spark, n=200, k=4, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 10, (k, 5))
    return spark.createDataFrame([(i, [float(x) for x in centre[i % k] + rng.normal(0, 0.1, 5)]) for i in range(n)], "node_id long, vec array<double>")


def ring_of_cliques(n, size, rnd):
    edges = [(c * size + a, c * size + b) for c in range(n) for a in range(size) for b in range(size) if a != b]
    return edges + [(c * size, (c + 1) % n * size) for c in range(n)] + [((c + 1) % n * size, c * size) for c in range(n)]


def test_kmeans_finds_blobs(spark):
    got = {r.node_id: r.cluster for r in cluster.kmeans(blobs(spark), 4).collect()}
    parts = defaultdict(set)
    for i, c in got.items():
        parts[c].add(i % 4)
    assert len(got) == 200 and len(parts) == 4 and all(len(p) == 1 for p in parts.values())


def test_kmeans_with_fewer_vectors_than_clusters(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "node_id long, vec array<double>")
    assert {r.cluster for r in cluster.kmeans(same, 3).collect()} == {0}


def test_empty_clusters_keep_their_centroid(spark):
    step = {r.cluster: (list(r.centroid), r.size) for r in cluster.lloyd_step(blobs(spark, 8, 2), [(0, [0.0] * 5), (1, [1e6] * 5)]).collect()}
    assert step[1] == ([1e6] * 5, 0) and step[0][1] == 8


def test_centroids_of_signed_bytes(spark):
    rows = spark.createDataFrame([(1, 0, [-3, 5]), (2, 0, [-4, 6]), (3, 1, [-128, 127])], "node_id long, cluster int, vec array<smallint>")
    got = {r.cluster: list(r.centroid) for r in cluster.centroids(rows).collect()}
    assert got == {0: [-4, 6], 1: [-128, 127]}
    compat = {r.cluster: list(r.centroid) for r in cluster.centroids(rows, compat=True).collect()}
    assert compat[0] == [253, 6]  # the mean of 253 and 252, half up


def test_statistics(spark):
    a = spark.createDataFrame([(i, i // 3) for i in range(5)], "node_id long, cluster int")
    e = spark.createDataFrame([(0, 1), (0, 3), (3, 4), (4, 0), (1, 99)], "node_id long, nbr long")
    assert cluster.size_stats(a).first()[:] == (2, 2, 3, 2.5, 0.2)
    assert cluster.edge_cut(e, a).first()[:] == (4, 2, 0.5)
    assert {tuple(r) for r in cluster.neighbour_clusters(e, a).collect()} == {(0, 1), (1, 1)}


def test_matching_is_mutual_and_coarsening_keeps_weight(spark):
    rnd = random.Random(1)
    pairs = spark.createDataFrame([(u, v, rnd.randint(1, 9)) for u in range(40) for v in range(u + 1, 40) if rnd.random() < 0.2], "u long, v long, w long")
    nodes = spark.createDataFrame([(i, 1) for i in range(40)], "id long, w long")
    into = cluster.heavy_edge_matching(pairs, nodes).cache()
    held = {r.id: r.into for r in into.collect()}
    assert set(held) == set(range(40)) and max(Counter(held.values()).values()) == 2
    linked = {(r.u, r.v) for r in pairs.collect()}
    assert all((into_, i) in linked for i, into_ in held.items() if i != into_)
    assert cluster.coarse_vertices(nodes, into).agg(F.sum("w")).first()[0] == 40
    coarse = cluster.coarse_edges(pairs, into)
    inside = sum(r.w for r in pairs.collect() if held[r.u] == held[r.v])
    assert coarse.agg(F.sum("w")).first()[0] + inside == pairs.agg(F.sum("w")).first()[0]


def test_partition_is_balanced_and_cuts_little(spark):
    edges = ring_of_cliques(8, 6, random.Random(2))
    e = spark.createDataFrame([(u, v, 0) for u, v in edges], "node_id long, nbr long, slot int")
    v = spark.createDataFrame([(i,) for i in range(48)], "node_id long")
    got = {r.node_id: r.cluster for r in cluster.partition_graph(e, v, 4, 0.05).collect()}
    sizes = Counter(got.values())
    assert set(got) == set(range(48)) and max(sizes.values()) <= 13
    assert sum(got[a] != got[b] for a, b in edges) < 0.35 * len(edges)


def test_strategies(spark):
    v = blobs(spark, 20, 2)
    assert cluster.cluster(v, method="K-Means", clusters=2).count() == 20
    with pytest.raises(ValueError):
        cluster.cluster(v, method="spectral", clusters=2)
    with pytest.raises(ValueError):
        cluster.cluster(v, method="graph", clusters=2)
