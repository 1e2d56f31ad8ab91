"""Proximity graphs: levels, construction, diversity pruning, symmetric forms, and searches in rounds.

Construction is by batches, not by insertion: rows meet within cells (nearest pivots of a bounded sample, several for each
row), where candidate edges come from one matrix product; candidates are pruned for diversity, reversed and capped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkann.functions.codes import hnsw_level, uniform
from sparkann.functions.vectors import distance
from sparkann.operators.knn import as_matrix, exact_topk, pair_distances, smallest
from sparkann.sources.scratch import written

#: Rows of a sample that pivots come from, rows of a cell, and cells that each row joins.
SAMPLE, CELL, PROBES = 4096, 2048, 3


def levels(vectors: DataFrame, m: int = 16, seed: int = 0) -> DataFrame:
    """node_id, level: geometric, drawn by a hash of the id."""
    return vectors.select("node_id", hnsw_level(uniform(F.col("node_id"), F.lit(seed)), m).alias("level"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Distinct edges both ways, without loops."""
    held = edges.where("node_id <> nbr").select("node_id", "nbr")
    return held.unionAll(held.select(F.col("nbr").alias("node_id"), F.col("node_id").alias("nbr"))).distinct()


def valid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose neighbour is a node."""
    return edges.join(nodes.select(F.col("node_id").alias("nbr")), "nbr", "left_semi")


def at_level(edges: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Edges whose neighbour reaches a level; nodes: node_id, level."""
    return edges.join(nodes.where(F.col("level") >= level).select(F.col("node_id").alias("nbr")), "nbr", "left_semi")


def diverse(dist: np.ndarray, between: np.ndarray, m: int) -> list[int]:
    """Up to m of the candidates, nearest first: one is kept if it is nearer to the node than to all kept before; the rest
    fills up by distance."""
    order = np.argsort(dist, kind="stable").tolist()
    kept: list[int] = []
    for i in order:
        if len(kept) == m:
            break
        if all(between[i, j] >= dist[i] for j in kept):
            kept.append(i)
    return kept + [i for i in order if i not in kept][: m - len(kept)]


def cell_edges(m: int, candidates: int, metric: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, vecs = pdf["node_id"].to_numpy(np.int64), np.array(pdf["vec"].tolist(), np.float64)
        out = []
        dist = pair_distances(vecs, vecs, metric)
        np.fill_diagonal(dist, np.inf)
        k = min(candidates, len(ids) - 1)
        if k > 0:
            near, near_at = smallest(dist, np.arange(len(ids)), k)
            for i in range(len(ids)):
                at = near_at[:, i]
                for j in diverse(near[:, i], dist[np.ix_(at, at)], m):
                    out.append((ids[i], ids[at[j]], near[j, i]))
        return pd.DataFrame(out, columns=["node_id", "nbr", "dist"])

    return run


def in_cells(vectors: DataFrame, metric: str, probes: int = PROBES, cell: int = CELL) -> DataFrame:
    """node_id, vec, cell: each row with its nearest pivots. Cells beyond the size are dealt to blocks of half
    the size, and any two blocks of a cell meet in one split, so that no pair of a cell is lost."""
    n = vectors.count()
    wanted = max(1, min(SAMPLE, -(-n * probes // cell)))
    sample = vectors.orderBy(F.xxhash64("node_id"), "node_id").limit(wanted).select("vec").collect()
    pivots = np.array([r["vec"] for r in sample], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                dist = pair_distances(as_matrix(part["vec"]), pivots, metric)
                near = np.argsort(dist, axis=1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(part.num_rows), near.shape[1])
                picked = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part["node_id"].take(picked), part["vec"].take(picked), pa.array(near.ravel().astype(np.int32))], ["node_id", "vec", "cell"])

    schema = T.StructType([*vectors.select("node_id", "vec").schema.fields, T.StructField("cell", T.IntegerType())])
    dealt = written(vectors.select("node_id", "vec").mapInArrow(run, schema), "cells")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"))  # SAMPLE rows at most
    blocks = F.when(F.col("n") <= cell, 1).otherwise(F.ceil(F.col("n") * 2 / cell)).cast("long")
    held = dealt.join(F.broadcast(sizes), "cell").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node_id"), F.col("blocks")))
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("blocks = 1 or other <> own")
    return met.select("node_id", "vec", "cell", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("split"))


def build_level(vectors: DataFrame, m: int, cap: int, candidates: int, metric: str) -> DataFrame:
    """node_id, slot, nbr, dist of one level: m diverse neighbours, their reverse edges, cap by distance."""
    found = in_cells(vectors, metric).groupBy("cell", "split").applyInPandas(cell_edges(m, candidates, metric), "node_id long, nbr long, dist double")
    found = written(found.groupBy("node_id", "nbr").agg(F.min("dist").alias("dist")), "candidates")
    order = Window.partitionBy("node_id").orderBy("dist", "nbr")
    own = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= m).drop("r")
    both = own.unionAll(own.select(F.col("nbr").alias("node_id"), F.col("node_id").alias("nbr"), "dist")).distinct()
    return both.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < cap).select("node_id", "slot", "nbr", "dist")


def build_graph(vectors: DataFrame, m: int = 16, ef_construction: int = 200, metric: str = "l2", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """vectors: node_id, vec. Returns nodes (node_id, level) and edges (node_id, level, slot, nbr, dist), 2 m neighbours on
    level 0 and m above."""
    nodes = written(levels(vectors, m, seed), "levels")
    most = nodes.agg(F.max("level")).first()[0] or 0
    edges = None
    for level in range(most + 1):
        held = vectors if level == 0 else vectors.join(nodes.where(F.col("level") >= level), "node_id", "left_semi")
        own = build_level(held, m, 2 * m if level == 0 else m, ef_construction, metric).withColumn("level", F.lit(level))
        edges = own if edges is None else edges.unionByName(own)
    return nodes, written(edges.select("node_id", "level", "slot", "nbr", "dist"), "edges")


def scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, metric: str) -> DataFrame:
    """qid, node_id, dist of pairs."""
    q = queries.select("qid", F.col("vec").alias("qvec"))
    return pairs.join(vectors.select("node_id", "vec"), "node_id").join(q, "qid").select("qid", "node_id", distance("qvec", "vec", metric).alias("dist"))


def best_of(found: DataFrame, ef: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "node_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= ef).drop("r")


def beam(queries: DataFrame, vectors: DataFrame, edges: DataFrame, entry: DataFrame, ef: int, metric: str, hops: int) -> DataFrame:
    """qid, node_id, dist: the ef nearest reached from entry (qid, node_id). Each hop expands all open nodes among the best
    ef; it ends when none is open. State is a few tables of ef rows a query, joined to edges and vectors by id."""
    best = written(scored(entry, queries, vectors, metric).withColumn("open", F.lit(True)), "beam")
    seen = best.select("qid", "node_id")
    for _ in range(hops):
        frontier = best.where("open").select("qid", "node_id")
        if not frontier.limit(1).count():
            break
        reached = frontier.join(edges.select("node_id", "nbr"), "node_id").select("qid", F.col("nbr").alias("node_id")).distinct()
        fresh = written(scored(reached.join(seen, ["qid", "node_id"], "left_anti"), queries, vectors, metric), "reached")
        seen = written(seen.unionAll(fresh.select("qid", "node_id")), "seen")
        best = written(best_of(best.withColumn("open", F.lit(False)).unionAll(fresh.withColumn("open", F.lit(True))), ef), "beam")
    return best.select("qid", "node_id", "dist")


def graph_search(queries: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10, ef: int | None = None, metric: str = "l2", hops: int = 64, exclude_self: bool = False) -> DataFrame:
    """Greedy descent through the upper levels, beam on level 0. Returns qid, rank, node_id, dist."""
    ef = ef or max(16, k)
    top = nodes.agg(F.max(F.struct("level", (-F.col("node_id")).alias("minus")))).first()[0]
    if top is None:
        return queries.sparkSession.createDataFrame([], "qid long, rank int, node_id long, dist double")
    at = queries.select("qid", F.lit(-top["minus"]).alias("node_id"))
    for level in range(top["level"], 0, -1):
        at = beam(queries, vectors, edges.where(F.col("level") == level), at, 1, metric, hops).select("qid", "node_id")
    found = beam(queries, vectors, edges.where(F.col("level") == 0), at, ef + exclude_self, metric, hops)
    if exclude_self:
        found = found.where("qid <> node_id")
    order = Window.partitionBy("qid").orderBy("dist", "node_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "node_id", "dist")


def wide_enough(vectors: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, ef: int, metric: str = "l2", reach: float = 0.93, rows: int = 128) -> int:
    """A beam's width, ef at least, by which a sample of rows (drawn by a hash, asked as queries) finds that share of its exact k
    nearest: four times as wide until it does, or until the beam holds all rows. How wide depends on rows and dimensions."""
    asked = written(vectors.where("vec is not null").orderBy(F.xxhash64("node_id", F.lit(1)), "node_id").limit(rows).select(F.col("node_id").alias("qid"), "vec"), "sample")
    truth = written(exact_topk(asked, vectors, k, metric).select("qid", "node_id"), "sample-truth")
    n, truths = vectors.count(), truth.count()
    while ef < n:
        found = graph_search(asked, vectors, nodes, edges, k, ef, metric, exclude_self=True)
        if found.join(truth, ["qid", "node_id"], "left_semi").count() >= reach * truths:
            break
        ef *= 4
    return ef


def bfs_order(members: list[int], near: dict[int, list[int]]) -> list[int]:
    """Breadth-first order within one cluster, from the member with most neighbours there (least id among equals), begun
    anew from the best one left."""
    inside = set(members)
    own = {u: [v for v in near.get(u, []) if v in inside] for u in members}
    starts = sorted(members, key=lambda u: (-len(own[u]), u))
    seen: set[int] = set()
    out: list[int] = []
    for s in starts:
        if s in seen:
            continue
        seen.add(s)
        queue = [s]
        for u in queue:
            out.append(u)
            for v in own[u]:
                if v not in seen:
                    seen.add(v)
                    queue.append(v)
    return out


def cluster_bfs(assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, cluster, pos: each cluster in breadth-first order. Clusters are balanced, so a cluster fits a task."""
    inside = edges.join(assignment, "node_id").join(assignment.select(F.col("node_id").alias("nbr"), F.col("cluster").alias("cv")), "nbr").where("cluster = cv")
    lists = inside.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("slot", "nbr"))).alias("l")).select("node_id", F.transform("l", lambda s: s["nbr"]).alias("nbrs"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = defaultdict(list)
        for u, l in zip(pdf["node_id"], pdf["nbrs"], strict=True):
            near[int(u)] = [int(v) for v in l] if l is not None else []
        order = bfs_order([int(u) for u in pdf["node_id"]], near)
        return pd.DataFrame({"node_id": order, "cluster": [pdf["cluster"].iloc[0]] * len(order), "pos": range(len(order))})

    return assignment.join(lists, "node_id", "left").groupBy("cluster").applyInPandas(run, "node_id long, cluster int, pos int")
