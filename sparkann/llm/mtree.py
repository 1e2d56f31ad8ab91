"""Exact top-k by inner product with an M-tree and best-first search (operator 2).

Vectors become integers, floor(1024 * x) for each component. With M the largest squared norm, adding the component
sqrt(M - |x|^2) to each vector, and 0 to a query, makes distance a function of the score alone: d^2 = |q|^2 + M - 2 q.x.
So the highest scores are the nearest vectors of a metric space, and scores stay exact integers.

The index is a table of pages. The root is a page of at most PIVOTS routing objects, taken from a bounded sample of SAMPLE
rows (least hash first). Each row belongs to its nearest routing object; cells with more than TREE rows are split among
several subtrees by a hash of the row, so a very common vector fills many subtrees and none beyond its size. A subtree
is bulk-loaded into pages of CAPACITY entries; entries keep the distance to the parent's routing object, routing entries
also their covering radius.

A search starts with the k-th best score within the sample, which bounds the result from the beginning. Cells whose ball
cannot reach it are left out. In each subtree, pages are taken from a queue, least possible distance first, and stored
distances to parents rule entries out by the triangle inequality before any distance is computed. Queries go through the
subtrees in blocks of about BLOCK; each block and subtree give at most k candidates for the final ranking.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors are padded
with zeros to the longest; rows with a null vec_id are no queries and rank after all ids among equal scores; rows that
repeat vec_id and vector are one query, and one candidate each; rows with the query's vec_id are no candidates of it;
an empty table gives an empty result. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkann.llm.common import written

K, SCALE = 10, 1024.0
SAMPLE, PIVOTS, TREE, CAPACITY, BLOCK = 2048, 1024, 1024, 128, 4096
PAGES = "tree int, page int, leaf boolean, ids binary, vectors binary, parent_distances binary, radii binary, children binary"
#: Stands for a null vec_id within pages.
NO_ID = np.iinfo(np.int64).max


def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, vec (its integers as 64-bit little-endian), dim and norm2 of each usable vector."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            part = part.filter(pc.is_valid(part["embedding"]))
            ids, vecs, dims, norms = [], [], [], []
            for vec_id, x in zip(part["vec_id"].to_pylist(), part["embedding"], strict=True):
                x = x.values
                if x.null_count:
                    continue
                x = np.asarray(x, np.float64)
                if not np.isfinite(x).all():
                    continue
                v = np.floor(SCALE * x).astype("<i8")
                ids.append(vec_id)
                vecs.append(v.tobytes())
                dims.append(len(v))
                norms.append(int(v @ v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.int64())], ["vec_id", "vec", "dim", "norm2"])


def matrix(vecs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.ljust(8 * dim, b"\0") for v in vecs), "<i8").reshape(-1, dim)


class Space:
    """Scores as exact integers, and distances in the space with the added component."""

    def __init__(self, dim: int, norm2: int):
        self.dim, self.norm2 = dim, norm2
        self.small = norm2 * max(dim, 1) < 2**52  # then sums of float64 products are exact

    def held(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(np.float64) if self.small else vectors

    def distance(self, scores: np.ndarray, norm2) -> np.ndarray:
        """From a query (its added component is 0)."""
        return np.sqrt(np.maximum(norm2 + float(self.norm2) - 2.0 * scores, 0.0))

    def between(self, a: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Distances of vectors (with their added components) from one of them."""
        a, one = a.astype(np.float64), one.astype(np.float64)
        added = lambda x: np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=-1), 0.0))
        return np.sqrt(np.maximum(((a - one) ** 2).sum(axis=-1) + (added(a) - added(one)) ** 2, 0.0))

    def slack(self, norm2: float) -> float:
        return 1e-7 * (1.0 + math.sqrt(norm2 + self.norm2))


def bulk_load(ids: np.ndarray, vectors: np.ndarray, space: Space) -> list[tuple]:
    """Pages (page, leaf, ids, vectors, parent_distances, radii, children) of one subtree; page 0 is its root."""
    pages: list[tuple | None] = []

    def load(rows: np.ndarray, parent: np.ndarray | None) -> tuple[int, float]:
        """The page that holds rows, and their largest distance from parent."""
        page = len(pages)
        pages.append(None)
        far = space.between(vectors[rows], parent) if parent is not None else np.zeros(len(rows))
        if len(rows) <= CAPACITY:
            pages[page] = (page, True, ids[rows], vectors[rows], far, np.zeros(len(rows)), np.full(len(rows), -1, np.int32))
            return page, float(far.max(initial=0.0))
        k = min(CAPACITY, -(-len(rows) * 2 // CAPACITY))
        routing = rows[:: -(-len(rows) // k)]
        near = np.stack([space.between(vectors[rows], vectors[r]) for r in routing]).argmin(axis=0)
        parts = [rows[near == i] for i in range(len(routing))]
        if max(map(len, parts)) == len(rows):  # equal vectors: any cut is as good
            size = -(-len(rows) // k)
            parts = [rows[i : i + size] for i in range(0, len(rows), size)]
            routing = np.array([p[0] for p in parts])
        found = [(r, *load(p, vectors[r])) for r, p in zip(routing, parts, strict=False) if len(p)]
        own = np.array([r for r, _, _ in found])
        to_parent = space.between(vectors[own], parent) if parent is not None else np.zeros(len(own))
        pages[page] = (page, False, ids[own], vectors[own], to_parent, np.array([x for _, _, x in found]), np.array([c for _, c, _ in found], np.int32))
        return page, float(far.max(initial=0.0))

    load(np.arange(len(ids)), None)
    return pages


def builder(space: Space):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "vec"], na_position="last")
        ids = pdf["vec_id"].fillna(NO_ID).to_numpy(np.int64)
        rows = [(int(pdf["tree"].iloc[0]), page, leaf, i.astype("<i8").tobytes(), v.astype("<i8").tobytes(), *(x.astype("<f8").tobytes() for x in (d, r)), c.astype("<i4").tobytes()) for page, leaf, i, v, d, r, c in bulk_load(ids, matrix(pdf["vec"], space.dim), space)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")])

    return build


class Best:
    """The k best of what was offered: higher score first, then smaller id. A bound from elsewhere may hold at first."""

    def __init__(self, k: int, bound: float):
        self.k, self.bound, self.heap = k, bound, []

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.bound)
        for s, i in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (s, -i))
            elif (s, -i) > self.heap[0]:
                heapq.heapreplace(self.heap, (s, -i))
        if len(self.heap) == self.k:
            self.bound = max(self.bound, self.heap[0][0])


def search(pages: dict[int, tuple], space: Space, query_id: int, query: np.ndarray, bound: float, k: int) -> list[tuple[int, int]]:
    """Best-first search of one subtree: (score, id) of at most k rows whose scores reach the bound."""
    norm2 = float((query * query).sum())
    slack, best = space.slack(norm2), Best(k, bound)
    reach = lambda: space.distance(np.float64(best.bound), norm2) + slack if best.bound > -math.inf else math.inf
    queue, limit = [(0.0, 0, -1.0)], reach()
    while queue:
        least, page, to_parent = heapq.heappop(queue)
        if least > limit:
            break
        leaf, ids, vectors, parent_distances, radii, children = pages[page]
        if to_parent >= 0:  # triangle inequality: nothing computed for entries that cannot reach
            keep = np.flatnonzero(np.abs(to_parent - parent_distances) - radii <= limit)
            if not len(keep):
                continue
            ids, vectors, radii, children = ids[keep], vectors[keep], radii[keep], children[keep]
        scores = vectors @ query
        if leaf:
            own = ids != query_id
            best.offer(scores[own], ids[own])
            limit = reach()
        else:
            distances = space.distance(scores, norm2)
            nearest = np.maximum(distances - radii, 0.0)
            for i in np.flatnonzero(nearest <= limit).tolist():
                heapq.heappush(queue, (nearest[i], int(children[i]), distances[i]))
    return [(int(s), -i) for s, i in best.heap]


def searcher(space: Space, k: int):
    def run(key, pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for p in pages.itertuples(index=False) if len(queries) else ():
            ids = np.frombuffer(p.ids, "<i8")
            held[p.page] = (p.leaf, ids, space.held(np.frombuffer(p.vectors, "<i8").reshape(len(ids), space.dim)), np.frombuffer(p.parent_distances, "<f8"), np.frombuffer(p.radii, "<f8"), np.frombuffer(p.children, "<i4"))
        rows = []
        for q in queries.itertuples(index=False) if held else ():
            query = space.held(matrix([q.vec], space.dim))[0]
            rows += [(q.query_id, q.vec, None if i == NO_ID else i, s) for s, i in search(held, space, q.query_id, query, q.bound, k)]
        return pd.DataFrame(rows, columns=["query_id", "vec", "vec_id", "score"]).astype({"vec_id": "Int64"})

    return run


def assigner(space: Space, pivots: np.ndarray):
    held = pivots.astype(np.float64)
    added = np.sqrt(np.maximum(space.norm2 - (held * held).sum(axis=1), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = matrix(part["vec"].to_pylist(), space.dim).astype(np.float64)
                own = np.sqrt(np.maximum(space.norm2 - (v * v).sum(axis=1), 0.0))
                nearest = (v @ held.T + np.outer(own, added)).argmax(axis=1)  # all norms are equal with the added component
                far = np.array([space.between(x, held[p]) for x, p in zip(v, nearest, strict=True)])
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["vec"], pa.array(nearest.astype(np.int32)), pa.array(far, pa.float64())], ["vec_id", "vec", "pivot", "far"])

    return run


def router(space: Space, pivots: np.ndarray, radii: np.ndarray, trees: list[tuple[int, int]], sample_ids: np.ndarray, sample: np.ndarray, k: int):
    """Queries with the subtrees that can hold one of their results, and the score that their results must reach."""
    held, sampled = space.held(pivots), space.held(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query_id, vec in zip(batch["query_id"].to_pylist(), batch["vec"].to_pylist(), strict=True):
                q = space.held(matrix([vec], space.dim))[0]
                norm2 = float((q * q).sum())
                scores = np.sort((sampled @ q)[sample_ids != query_id])[::-1]
                bound = float(scores[k - 1]) if len(scores) >= k else -math.inf
                limit = space.distance(np.float64(bound), norm2) + space.slack(norm2) if bound > -math.inf else math.inf
                for pivot in np.flatnonzero(space.distance(held @ q, norm2) - radii <= limit).tolist():
                    first, n = trees[pivot]
                    rows += [(query_id, vec, bound, first + i) for i in range(n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.float64(), pa.int32()), strict=True)], ["query_id", "vec", "bound", "tree"])

    return run


class Index:
    """An M-tree over all usable vectors; pages holds its subtrees, the root stays with the driver (PIVOTS entries)."""

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        self.vectors = written(raw.mapInArrow(integers, "vec_id long, vec binary, dim int, norm2 long"), "vectors")
        dim, norm2, n = self.vectors.agg(F.max("dim"), F.max("norm2"), F.count("*")).first()
        self.rows, self.space = n, Space(dim or 0, norm2 or 0)
        if not n:
            return
        sample = self.vectors.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").select("vec_id", "vec").limit(SAMPLE).collect()
        self.sample_ids = np.array([NO_ID if r[0] is None else r[0] for r in sample], np.int64)
        self.sample = matrix([bytes(r[1]) for r in sample], self.space.dim)
        self.pivots = np.unique(self.sample[: min(PIVOTS, max(1, 2 * n // TREE))], axis=0)
        cells = written(self.vectors.select("vec_id", "vec").mapInArrow(assigner(self.space, self.pivots), "vec_id long, vec binary, pivot int, far double"), "cells")
        sizes = {r[0]: (r[1], r[2]) for r in cells.groupBy("pivot").agg(F.count("*"), F.max("far")).collect()}  # PIVOTS at most
        self.radii = np.array([sizes.get(i, (0, 0.0))[1] for i in range(len(self.pivots))])
        self.trees, first = [], 0
        for i in range(len(self.pivots)):
            self.trees.append((first, -(-sizes.get(i, (0, 0.0))[0] // TREE)))
            first += self.trees[-1][1]
        at = self.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.trees) if b], "pivot int, first int, parts int")
        tree = F.col("first") + F.pmod(F.xxhash64("vec_id", "vec", "row"), F.col("parts")).cast("int")
        dealt = cells.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(at), "pivot").select("vec_id", "vec", tree.alias("tree"))
        self.pages = written(dealt.groupBy("tree").applyInPandas(builder(self.space), PAGES), "pages")

    def top_k(self, queries: DataFrame, k: int = K) -> DataFrame:
        """queries: query_id, vec. Returns query_id, rank, vec_id, score."""
        blocks = max(1, -(-queries.count() // BLOCK))
        block = F.pmod(F.xxhash64("query_id", "vec"), F.lit(blocks)).cast("int")
        route = router(self.space, self.pivots, self.radii, self.trees, self.sample_ids, self.sample, k)
        routed = queries.select("query_id", "vec").mapInArrow(route, "query_id long, vec binary, bound double, tree int").withColumn("block", block)
        pages = self.pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = pages.groupBy("tree", "block").cogroup(routed.groupBy("tree", "block")).applyInPandas(searcher(self.space, k), "query_id long, vec binary, vec_id long, score long")
        order = Window.partitionBy("query_id", "vec").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by every."""
    index = Index(vectors)
    if not index.rows:
        return index.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = index.vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    return index.top_k(queries, k)


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op2_mtree_topk": op2_mtree_topk}
SQL = {
    "op2_mtree_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""
}
