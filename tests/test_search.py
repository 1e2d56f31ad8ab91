import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkann.operators import cluster, evaluate, knn, layout, pir, search


@pytest.fixture(scope="module")
def index(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 60, (6, 8))
    rows = [(i, i % 6, [int(x) for x in np.clip(np.round(centre[i % 6] + rng.normal(0, 25, 8)), -128, 127)]) for i in range(240)]
    q = spark.createDataFrame(rows, "node_id long, cluster int, qvec array<smallint>").cache()
    laid = layout.layout(q.select("node_id", "cluster"), 8).cache()
    vectors = q.select("node_id", F.col("qvec").alias("vec"))
    edges = knn.knn_graph(vectors, 6, "ip").cache()
    centres = cluster.centroids(q.select("node_id", "cluster", F.col("qvec").alias("vec"))).cache()
    asked = q.where("node_id < 12").select(F.col("node_id").alias("qid"), "qvec").cache()
    truth = knn.exact_topk(asked.select("qid", F.col("qvec").alias("vec")), vectors, 10, "ip", exclude_self=False).cache()
    return q, laid, edges, centres, asked, truth


def run(index, flags="", **options):
    q, laid, edges, centres, asked, _ = index
    return search.routed_search(asked, laid, q.select("node_id", "qvec"), edges, centres, 10, 50, search.SearchConfig.from_flags(flags), **options)


def test_recall_and_stats(index):
    found, stats = run(index)
    found = found.cache()
    assert evaluate.recall(found, index[5], 10).first()["recall"] >= 0.8
    for r in stats.collect():
        assert (r.embedding_requests, r.neighbour_requests, r.round_trips) == (11, 10, 11)
        assert 1 <= r.clusters_fetched <= 11 and r.subgroups_fetched <= 10
    ids = [(r.qid, r.node_id) for r in found.collect()]
    assert len(ids) == len(set(ids)) == 120


def test_dist_is_the_inner_product(index):
    q = {r.node_id: np.array(r.qvec, int) for r in index[0].collect()}
    for r in run(index, "rounds_1")[0].collect():
        assert r.dist == -int(q[r.qid] @ q[r.node_id])


def test_more_rounds_find_no_less(index):
    truth = index[5]
    few, many = (evaluate.recall(run(index, f)[0], truth, 10).first()["recall"] for f in ("rounds_1,no_topcand", "rounds_5,no_prune,centroid_entry_3"))
    assert many >= few


def test_private_search_finds_the_same(index):
    q, laid, edges, centres, asked, truth = index
    members = laid.join(q.select("node_id", "qvec"), "node_id")
    scorer = search.private_scorer(asked.where("qid < 3"), members, pir.EmbeddingScheme(6, 8, n=32), seed=4)
    found, _ = search.routed_search(asked.where("qid < 3"), laid, q.select("node_id", "qvec"), edges, centres, 10, 50, search.SearchConfig(rounds=1), scorer)
    assert evaluate.recall(found, truth.where("qid < 3"), 10).first()["recall"] >= 0.6


def test_private_fetches_are_padded_and_find_the_plain_neighbours(spark, index):
    q, laid, edges, centres, asked, _ = index
    few = asked.where("qid < 3").cache()
    sizes = layout.shape(laid, 8, 6)
    config = search.SearchConfig(rounds=2, pad=True)
    held = q.select("node_id", "qvec")
    plain, stats = search.routed_search(few, laid, held, edges, centres, 10, 50, config)
    through, _ = search.routed_search(few, laid, held, edges, centres, 10, 50, config, fetcher=search.private_fetcher(laid, edges, sizes, 32, 7))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, through.collect()))
    for r in stats.collect():
        assert r.clusters_fetched + r.clusters_padded == r.embedding_requests == 5
        assert r.subgroups_fetched + r.subgroups_padded == r.neighbour_requests == 4


def test_padding_fills_every_round(spark):
    scores = spark.createDataFrame([(q, c, 0) for q in (1, 2) for c in range(5)], "qid long, cluster int, cent_dist long")
    chosen = spark.createDataFrame([(1, 3)], "qid long, cluster int")
    got = [(r.qid, r.cluster) for r in search.padded_clusters(chosen, scores, 2, 1).collect()]
    assert len(got) == len(set(got)) == 4 and (1, 3) in got and sum(q == 2 for q, _ in got) == 2
    wanted = spark.createDataFrame([(1, 7)], "qid long, sg_col int")
    got = [(r.qid, r.sg_col) for r in search.padded_subgroups(wanted, scores.select("qid").distinct(), 10, 2, 1).collect()]
    assert len(got) == 4 and (1, 7) in got and all(0 <= c < 10 for _, c in got)


def test_flags():
    c = search.SearchConfig.from_flags("no_prune,no_topcand,no_batch,rounds_3,centroid_entry_2")
    assert (c.prune, c.top_candidates, c.batch, c.rounds, c.entry_clusters) == (False, 0, False, 3, 2)
    with pytest.warns(UserWarning):
        search.SearchConfig.from_flags("stale_4")
    with pytest.raises(ValueError):
        search.SearchConfig.from_flags("no_such_flag")


def test_pruning_and_entries(spark):
    p = spark.createDataFrame([(1, 0, -100), (1, 1, -90), (1, 2, -80), (2, 0, 5)], "qid long, cluster int, cent_dist long")
    best = p.groupBy("qid").agg(F.min("cent_dist").alias("best"))
    assert {(r.qid, r.cluster) for r in search.pruned(p, best, 0.85).collect()} == {(1, 0), (1, 1), (2, 0)}
    assert [(r.qid, r.cluster, r["rank"]) for r in search.entries(p, 2).orderBy("qid", "rank").collect()] == [(1, 0, 1), (1, 1, 2), (2, 0, 1)]


def test_batches_stop_at_the_subgroup_too_many(spark):
    rows = [(1, n, 0, sg, d) for n, sg, d in ((10, 5, 1), (11, 6, 2), (12, 5, 3), (13, 7, 4), (14, 5, 5), (15, 9, 6))]
    state = spark.createDataFrame([(*r, True, True, False, True) for r in rows], "qid long, new_id long, cluster int, sg_col int, dist long, visited boolean, candidate boolean, popped boolean, offered boolean")
    none = spark.createDataFrame([], "qid long, sg_col int")
    taken, wanted = search.batch_of(state, none, 50, 2)
    assert {r.new_id for r in taken.collect()} == {10, 11, 12} and {r.sg_col for r in wanted.collect()} == {5, 6}
    held = spark.createDataFrame([(1, 7)], "qid long, sg_col int")
    taken, wanted = search.batch_of(state, held, 50, 2)
    assert {r.new_id for r in taken.collect()} == {10, 11, 12, 13, 14}


def test_pool():
    assert search.pool_size([], 50, 100) == 30 and search.pool_size([10, 20], 50, 100) == 16
    assert len(search.secret_pool(pir.EmbeddingScheme(2, 2, n=8), 3, 1)) == 3
