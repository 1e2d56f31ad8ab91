"""Clusterings: k-means, balanced multilevel graph partitioning, and their statistics."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkann.functions.codes import auto_clusters
from sparkann.operators.knn import as_matrix
from sparkann.sources.scratch import written

IMBALANCE = 0.05


# --- statistics -----------------------------------------------------------------------------------------------------


def cluster_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("cluster").agg(F.count("*").alias("size"))


def size_stats(assignment: DataFrame) -> DataFrame:
    """clusters, smallest, largest, average and imbalance (largest over average, less one)."""
    r = cluster_sizes(assignment).agg(F.count("*").alias("clusters"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.avg("size").alias("average"))
    return r.withColumn("imbalance", (F.col("largest") - F.col("average")) / F.col("average"))


def labelled_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """node_id, nbr and the clusters of both, for edges whose ends are assigned."""
    a = assignment.select("node_id", F.col("cluster").alias("cu"))
    b = assignment.select(F.col("node_id").alias("nbr"), F.col("cluster").alias("cv"))
    return edges.join(a, "node_id").join(b, "nbr").select("node_id", "nbr", "cu", "cv")


def edge_cut(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """edges, cut and cut_ratio of directed edges."""
    r = labelled_edges(edges, assignment).agg(F.count("*").alias("edges"), F.count_if(F.col("cu") != F.col("cv")).alias("cut"))
    return r.withColumn("cut_ratio", F.col("cut") / F.col("edges"))


def neighbour_clusters(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """For each cluster: how many other clusters its nodes have neighbours in."""
    other = labelled_edges(edges, assignment)
    return other.groupBy(F.col("cu").alias("cluster")).agg(F.count_distinct(F.when(F.col("cu") != F.col("cv"), F.col("cv"))).alias("neighbour_clusters"))


def centroids(vectors: DataFrame, is_unsigned: bool = False, integer: bool = True, compat: bool = False) -> DataFrame:
    """Mean of each cluster's vectors (node_id, cluster, vec). integer: rounded and clamped to a byte. compat: signed bytes are
    averaged as if unsigned. A cluster's components are summed one by one with partial sums, so its size doesn't matter."""
    x = F.col("x").cast("double")
    if compat:
        x = F.pmod(x, F.lit(256.0))
    mean = F.avg(x)
    if integer and (is_unsigned or compat):
        mean = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(mean + 0.5)))
    elif integer:
        mean = F.greatest(F.lit(-128), F.least(F.lit(127), F.round(mean)))
    parts = vectors.select("cluster", F.posexplode("vec").alias("i", "x")).groupBy("cluster", "i").agg(mean.cast("smallint" if integer else "double").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return parts.groupBy("cluster").agg(F.transform(ordered, lambda s: s["x"]).alias("centroid"))


# --- k-means --------------------------------------------------------------------------------------------------------


def nearest_centroid(vectors: DataFrame, found: list[tuple[int, list[float]]]) -> DataFrame:
    """node_id, vec, cluster and dist (squared L2); ties to the least cluster. found: the centroids, which every task holds."""
    names = np.array([i for i, _ in found], np.int32)
    held = np.array([c for _, c in found], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vecs = as_matrix(part["vec"])
                dist = np.stack([((vecs - c) ** 2).sum(axis=1) for c in held])
                best = dist.argmin(axis=0)
                yield pa.RecordBatch.from_arrays([part["node_id"], part["vec"], pa.array(names[best]), pa.array(dist.min(axis=0))], ["node_id", "vec", "cluster", "dist"])

    held_rows = vectors.select("node_id", "vec").where("vec is not null")
    schema = T.StructType([*held_rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("dist", T.DoubleType())])
    return held_rows.mapInArrow(run, schema)


def kmeans_pp(vectors: DataFrame, k: int, seed: int = 42) -> list[list[float]]:
    """k-means++ seeds: each next one drawn with probability by its squared distance, by one weighted-key aggregate."""
    first = vectors.select("vec").orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(1).collect()
    chosen = [[float(x) for x in r["vec"]] for r in first]
    while chosen and len(chosen) < k:
        near = nearest_centroid(vectors, list(enumerate(chosen)))
        u = (F.pmod(F.xxhash64("node_id", F.lit(seed + len(chosen))), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
        drawn = near.where("dist > 0").agg(F.max_by("vec", F.ln(u) / F.col("dist")).alias("vec")).first()["vec"]
        if drawn is None:
            break  # fewer different vectors than k
        chosen.append([float(x) for x in drawn])
    return chosen


def lloyd_step(vectors: DataFrame, found: list[tuple[int, list[float]]]) -> DataFrame:
    """New centroids (cluster, centroid, size). A cluster without rows keeps its centroid."""
    near = nearest_centroid(vectors.select("node_id", "vec"), found)
    mean = centroids(near, integer=False).join(cluster_sizes(near), "cluster")
    old = vectors.sparkSession.createDataFrame(found, "cluster int, old array<double>")
    return old.join(mean, "cluster", "left").select("cluster", F.coalesce("centroid", "old").alias("centroid"), F.coalesce("size", F.lit(0)).alias("size"))


def kmeans(vectors: DataFrame, k: int, iterations: int = 20, seed: int = 42) -> DataFrame:
    """node_id, cluster by Lloyd's steps until no centroid moves."""
    found = list(enumerate(kmeans_pp(vectors, k, seed)))
    for _ in range(iterations):
        after = sorted((r["cluster"], list(r["centroid"])) for r in lloyd_step(vectors, found).collect())
        if after == found:
            break
        found = after
    return nearest_centroid(vectors, found).select("node_id", "cluster") if found else vectors.select("node_id", F.lit(0).alias("cluster"))


# --- graphs ---------------------------------------------------------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs u < v of weight 1, without loops."""
    pairs = edges.where("node_id <> nbr").select(F.least("node_id", "nbr").alias("u"), F.greatest("node_id", "nbr").alias("v")).distinct()
    return pairs.withColumn("w", F.lit(1).cast("long"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def proposals(pairs: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """u, v: each node's heaviest edge to another free node; ties by a hash of the pair, alike from both ends."""
    held = both_ways(pairs)
    if free is not None:
        held = held.join(free.select(F.col("id").alias("u")), "u", "left_semi").join(free.select(F.col("id").alias("v")), "v", "left_semi")
    rank = F.struct(F.col("w"), F.xxhash64(F.least("u", "v"), F.greatest("u", "v")).alias("h"), F.col("v"))
    return held.groupBy("u").agg(F.max(rank).alias("best")).select("u", F.col("best.v").alias("v"))


def heavy_edge_matching(pairs: DataFrame, vertices: DataFrame, rounds: int = 10) -> DataFrame:
    """id, into: matched nodes go together under the smaller id. Rounds of mutual proposals; what is left stays alone."""
    free, matched = vertices.select("id"), None
    for _ in range(rounds):
        p = written(proposals(pairs, free), "proposals")
        mutual = written(p.alias("a").join(p.alias("b"), F.expr("a.u = b.v and a.v = b.u and a.u < a.v")).select("a.u", "a.v"), "matched")
        if not mutual.limit(1).count():
            break
        matched = mutual if matched is None else matched.unionAll(mutual)
        free = written(free.join(mutual.select(F.explode(F.array("u", "v")).alias("id")), "id", "left_anti"), "free")
    if matched is None:
        return vertices.select("id", F.col("id").alias("into"))
    ends = matched.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("u").alias("into")), F.struct(F.col("v").alias("id"), F.col("u").alias("into")))).alias("m")).select("m.*")
    return ends.unionAll(vertices.select("id", F.col("id").alias("into")).join(ends, "id", "left_anti"))


def coarse_vertices(vertices: DataFrame, into: DataFrame) -> DataFrame:
    return vertices.join(into, "id").groupBy(F.col("into").alias("id")).agg(F.sum("w").alias("w"))


def coarse_edges(pairs: DataFrame, into: DataFrame) -> DataFrame:
    """Weights of pairs between the groups that nodes went into."""
    a, b = into.select(F.col("id").alias("u"), F.col("into").alias("a")), into.select(F.col("id").alias("v"), F.col("into").alias("b"))
    held = pairs.join(a, "u").join(b, "v").where("a <> b")
    return held.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w"))


def farthest_seeds(near: dict[int, dict[int, int]], parts: int) -> list[int]:
    """Nodes far from one another: each next one is the farthest from all before, by breadth-first search."""
    seeds = [max(near, key=lambda u: (len(near[u]), -u))]
    while len(seeds) < min(parts, len(near)):
        depth, queue = dict.fromkeys(seeds, 0), list(seeds)
        for u in queue:
            for v in near[u]:
                if v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
        seeds.append(max((u for u in near if u not in seeds), key=lambda u: (depth.get(u, len(near) + 1), -u)))
    return seeds


def grow(near: dict[int, dict[int, int]], weight: dict[int, int], parts: int, imbalance: float) -> dict[int, int]:
    """Greedy growth from far seeds under a largest part weight; what is left goes to the lightest part. Small graphs only."""
    limit = (1 + imbalance) * sum(weight.values()) / parts
    where = {u: p for p, u in enumerate(farthest_seeds(near, parts))}
    load = defaultdict(int)
    for u, p in where.items():
        load[p] += weight[u]
    while len(where) < len(near):
        pull: dict[tuple[int, int], int] = defaultdict(int)
        for u, p in where.items():
            for v, w in near[u].items():
                if v not in where and load[p] + weight[v] <= limit:
                    pull[v, p] += w
        if pull:
            (u, p) = max(pull, key=lambda x: (pull[x], -load[x[1]], -x[0]))
        else:
            u, p = max((u for u in near if u not in where), key=lambda u: (weight[u], -u)), min(range(parts), key=lambda p: (load[p], p))
        where[u] = p
        load[p] += weight[u]
    return where


def gains(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """id, part, to_part, own: weight of a node's edges to each part, and to its own."""
    of_v = parts.select(F.col("id").alias("v"), F.col("part").alias("to"))
    pull = both_ways(pairs).join(of_v, "v").groupBy(F.col("u").alias("id"), "to").agg(F.sum("w").alias("pull"))
    held = pull.join(parts.select("id", "part"), "id")
    own = F.max(F.when(F.col("to") == F.col("part"), F.col("pull"))).over(Window.partitionBy("id"))
    return held.select("id", "part", "to", "pull", F.coalesce(own, F.lit(0)).alias("own"))


def refine(pairs: DataFrame, parts: DataFrame, n_parts: int, imbalance: float, iterations: int = 5) -> DataFrame:
    """Label propagation: nodes move where they gain edge weight, best gains first, as long as the target part has room.
    parts: id, part, w. The weights of parts are n_parts numbers."""
    for step in range(iterations):
        load = {r["part"]: r["w"] for r in parts.groupBy("part").agg(F.sum("w").alias("w")).collect()}
        total = sum(load.values())
        limit = (1 + imbalance) * total / n_parts
        room = parts.sparkSession.createDataFrame([(p, float(max(0.0, limit - load.get(p, 0)))) for p in range(n_parts)], "to int, room double")
        scored = gains(pairs, parts).where((F.col("to") != F.col("part")) & (F.col("pull") > F.col("own")))
        # Only half of the nodes move at a time, so that two neighbours don't change places.
        scored = scored.where(F.pmod(F.xxhash64("id", F.lit(step)), F.lit(2)) == 0)
        best = scored.groupBy("id").agg(F.max(F.struct((F.col("pull") - F.col("own")).alias("gain"), (-F.col("to")).alias("minus"))).alias("b")).select("id", F.col("b.gain").alias("gain"), (-F.col("b.minus")).alias("to"))
        taken = F.sum("w").over(Window.partitionBy("to").orderBy(F.desc("gain"), "id").rowsBetween(Window.unboundedPreceding, 0))
        moves = best.join(parts.select("id", "w"), "id").withColumn("taken", taken).join(room, "to").where("taken <= room").select("id", "to")
        moves = written(moves, "moves")
        if not moves.limit(1).count():
            break
        parts = written(parts.join(moves, "id", "left").select("id", F.coalesce("to", "part").cast("int").alias("part"), "w"), "parts")
    return parts


def balance(parts: DataFrame, n_parts: int, imbalance: float) -> DataFrame:
    """Move nodes out of parts beyond the limit into the free room of others, by prefix sums on both sides. At most one
    node beyond each limit stays where weights don't divide."""
    load = {r["part"]: r["w"] for r in parts.groupBy("part").agg(F.sum("w").alias("w")).collect()}
    limit = (1 + imbalance) * sum(load.values()) / n_parts
    if max(load.values(), default=0) <= limit:
        return parts
    upto = F.sum("w").over(Window.partitionBy("part").orderBy(F.desc("w"), "id").rowsBetween(Window.unboundedPreceding, 0))
    over = written(parts.withColumn("upto", upto).where(F.col("upto") > limit).select("id", "w", "part"), "over")
    spill, at = [], 0.0
    for p in range(n_parts):
        free = max(0.0, limit - load.get(p, 0))
        spill.append((p, at, at + free))
        at += free
    room = parts.sparkSession.createDataFrame(spill, "to int, lo double, hi double")
    line = F.sum("w").over(Window.orderBy("part", "id").rowsBetween(Window.unboundedPreceding, 0))
    moved = over.withColumn("line", line).join(F.broadcast(room), F.expr("line > lo and line <= hi")).select("id", "to")
    return parts.join(moved, "id", "left").select("id", F.coalesce("to", "part").alias("part"), "w")


def partition_graph(edges: DataFrame, vertices: DataFrame, n_parts: int, imbalance: float = IMBALANCE) -> DataFrame:
    """Balanced parts of a graph by coarsening, greedy growth and refinement. edges: node_id, nbr. vertices: node_id. Returns
    node_id, cluster. The coarsest graph, max(100, 10 * n_parts) nodes or where matching stalls, is grown by the driver."""
    pairs = written(undirected(edges), "pairs")
    nodes = written(vertices.select(F.col("node_id").alias("id"), F.lit(1).cast("long").alias("w")).distinct(), "vertices")
    levels, small = [], max(100, 10 * n_parts)
    n = nodes.count()
    while n > small:
        into = written(heavy_edge_matching(pairs, nodes), "matching")
        coarse = written(coarse_vertices(nodes, into), "vertices")
        m = coarse.count()
        if m > 0.9 * n:
            break
        levels.append((pairs, nodes, into))
        pairs, nodes, n = written(coarse_edges(pairs, into), "pairs"), coarse, m
    if n <= 100 * small:
        near: dict[int, dict[int, int]] = {r["id"]: {} for r in nodes.collect()}
        for r in pairs.collect():
            near[r["u"]][r["v"]] = near[r["v"]][r["u"]] = r["w"]
        weight = {r["id"]: r["w"] for r in nodes.collect()}
        where = grow(near, weight, n_parts, imbalance) if near else {}
        parts = nodes.sparkSession.createDataFrame([(u, p, weight[u]) for u, p in where.items()], "id long, part int, w long")
    else:  # a graph that doesn't coarsen: any even deal, refined below
        parts = nodes.select("id", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("part"), "w")
    parts = refine(pairs, written(parts, "parts"), n_parts, imbalance)
    for pairs, nodes, into in reversed(levels):
        down = into.join(parts.select(F.col("id").alias("into"), "part"), "into").join(nodes, "id").select("id", "part", "w")
        parts = refine(pairs, written(down, "parts"), n_parts, imbalance)
    return written(balance(parts, n_parts, imbalance), "parts").select(F.col("id").alias("node_id"), F.col("part").alias("cluster"))


# --- strategies -----------------------------------------------------------------------------------------------------


def by_kmeans(vectors: DataFrame, edges: DataFrame | None, clusters: int, **options) -> DataFrame:
    return kmeans(vectors, clusters, **options)


def by_graph(vectors: DataFrame, edges: DataFrame | None, clusters: int, **options) -> DataFrame:
    if edges is None:
        raise ValueError("graph clustering needs edges (node_id, nbr)")
    return partition_graph(edges, vectors, clusters, **options)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"kmeans": by_kmeans, "k-means": by_kmeans, "graph": by_graph, "graphpartition": by_graph, "graph_partition": by_graph}


def cluster(vectors: DataFrame, edges: DataFrame | None = None, method: str = "graph", clusters: int = 0, dim: int = 0, **options) -> DataFrame:
    """node_id, cluster by a strategy's name; clusters 0: the square root of rows over dimensions."""
    strategy = STRATEGIES.get(method.lower())
    if strategy is None:
        raise ValueError(f"no clustering {method!r}; there are {', '.join(STRATEGIES)}")
    return strategy(vectors, edges, clusters or auto_clusters(vectors.count(), dim), **options)
