"""Exact nearest neighbours: query blocks and base blocks meet in cells of bounded size, one matrix product per tile.

Vectors are packed once into blocks of raw numbers; the grid of cells is dealt to tasks, a cell to each, and nothing that grows
with the rows goes through the driver but the blocks' row counts. Partial results of a query meet in one merge.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkann.sources.scratch import written

#: Queries and base rows of one cell at most, bytes of one side at most, and rows under which a side isn't split any further.
BLOCK, BASE, BYTES, LEAST = 1 << 16, 1 << 17, 1 << 25, 2048
#: Rows of a packed block, queries that are merged together, and the tile of one matrix product.
PACK, PIECE, TILE = 1024, 4096, (512, 1024)
#: Cells wanted for each core, so that none waits long for another.
PER_CORE = 8
OUT = "qid long, rank int, node_id long, dist double"
PACKED = "blk long, n int, dim int, kind string, ids binary, vecs binary"


def as_matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, as float64 rows; shorter vectors are padded with zeros."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    sizes = np.diff(np.asarray(column.offsets)) if isinstance(column, (pa.ListArray, pa.LargeListArray)) else np.full(len(column), column.type.list_size)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    for row, (at, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes, strict=True)):
        out[row, :n] = flat[at : at + n]
    return out


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of a from all rows of b; exact where components are integers."""
    product = a @ b.T
    if metric == "ip":
        return -product
    if metric == "l2":
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * product
    if metric == "cosine":
        return 1 - product / np.sqrt(np.maximum(np.outer((a * a).sum(axis=1), (b * b).sum(axis=1)), 1e-20))
    raise ValueError(f"no metric {metric!r}")


def smallest(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each column with their ids, ties to smaller ids."""
    if len(dist) > 4 * k:  # narrow down first; equal distances at the edge all stay
        edge = np.partition(dist, k - 1, axis=0)[k - 1]
        rows = (dist <= edge).any(axis=1)
        dist, ids = dist[rows], ids[rows]
    order = np.lexsort((np.broadcast_to(ids[:, None], dist.shape), dist), axis=0)[:k]
    return np.take_along_axis(dist, order, axis=0), ids[order]


# --- one cell ---------------------------------------------------------------------------------------------------------


def operands(queries: np.ndarray, base: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and c with distances c - a @ b: for "l2" the base's squares are one more component, for "cosine" rows are divided by
    their norms. Single precision where all sums are integers that it holds exactly."""
    squares = lambda x: np.einsum("ij,ij->i", x, x)
    if metric == "ip":
        a, b, c = queries, base, np.zeros(len(queries))
    elif metric == "l2":
        a, b, c = np.column_stack([2 * queries, np.full(len(queries), -1.0)]), np.column_stack([base, squares(base)]), squares(queries)
    elif metric == "cosine":
        a, b = (x / np.sqrt(np.maximum(squares(x), 1e-20))[:, None] for x in (queries, base))
        c = np.ones(len(queries))
    else:
        raise ValueError(f"no metric {metric!r}")
    whole = metric != "cosine" and all((x == np.rint(x)).all() for x in (queries, base))
    if whole and float(np.abs(a).max(axis=0, initial=0) @ np.abs(b).max(axis=0, initial=0)) < 1 << 24:
        a, b = a.astype(np.float32), b.astype(np.float32)
    return a, np.ascontiguousarray(b.T), c


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest of each row, ties to lower columns, in order of rows."""
    if scores.shape[1] <= k:
        return np.divmod(np.arange(scores.size), scores.shape[1])
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    mask = scores >= edge[:, None]
    if np.count_nonzero(mask) <= 4 * k * len(scores):
        return np.divmod(np.flatnonzero(mask), scores.shape[1])
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # many equal ones
    return np.repeat(np.arange(len(scores)), k), order.ravel()


def nonzero(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few True ones, eight at a time."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return at[flat[at]]


def nearest(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int, metric: str, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat qid, id, dist of the k nearest finite ones of each query, ties to smaller ids. Base rows go by in order of ids, so one
    that comes later must be nearer than the k-th so far; few are, and only those are sorted."""
    order = np.argsort(ids, kind="stable")
    ids, base = ids[order], base[order]
    a, b, c = operands(queries, base, metric)
    tile_q, tile_b = TILE
    out: list[tuple[np.ndarray, ...]] = []
    room, marks = np.empty(tile_q * tile_b, a.dtype), np.empty(tile_q * tile_b, bool)
    for lo in range(0, len(qids), tile_q):
        own, names = a[lo : lo + tile_q], qids[lo : lo + tile_q]
        best, owner = np.full((len(own), k), -np.inf, a.dtype), np.full((len(own), k), np.iinfo(np.int64).max)
        for at in range(0, len(ids), tile_b):
            part = ids[at : at + tile_b]
            shape, size = (len(own), len(part)), len(own) * len(part)
            scores = np.matmul(own, b[:, at : at + tile_b], out=room[:size].reshape(shape))
            found = nonzero(np.greater(scores, best[:, -1:], out=marks[:size].reshape(shape)))
            if len(found) > 4 * k * len(own):
                if exclude_self:
                    scores[names[:, None] == part] = -np.inf
                row, col = best_columns(scores, k)
            else:
                row, col = np.divmod(found, len(part))
            keep = scores[row, col] > best[row, -1]
            if exclude_self:
                keep &= part[col] != names[row]
            row, col = row[keep], col[keep]
            if not len(row):
                continue
            rows, place = np.unique(row, return_inverse=True)
            r = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
            s = np.concatenate([best[rows].ravel(), scores[row, col]])
            i = np.concatenate([owner[rows].ravel(), part[col]])
            order = np.lexsort((i, -s, r))
            starts = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(rows)))[:-1]])
            order = order[(starts[:, None] + np.arange(k)).ravel()]
            best[rows], owner[rows] = s[order].reshape(-1, k), i[order].reshape(-1, k)
        there = np.isfinite(best)
        dist = c[lo : lo + tile_q, None] - best
        out.append((np.broadcast_to(names[:, None], there.shape)[there], owner[there], dist[there]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


# --- the grid ---------------------------------------------------------------------------------------------------------


def packed(rows: DataFrame, key: str, most: int = PACK) -> DataFrame:
    """Rows (key, vec) in written blocks of raw numbers. Rows without key or vector, or with components that are null or not
    finite, take no part: they have no distance."""
    element = rows.schema["vec"].dataType.elementType
    kind = {T.ByteType: "<i2", T.ShortType: "<i2", T.IntegerType: "<i4", T.FloatType: "<f4"}.get(type(element), "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, vecs = batch["id"].to_numpy(zero_copy_only=False), as_matrix(batch["vec"])
            fine = np.isfinite(vecs).all(axis=1)
            ids, vecs = ids[fine], vecs[fine]
            for at in range(0, len(ids), most):
                i, v = ids[at : at + most], vecs[at : at + most]
                yield pa.RecordBatch.from_pylist([{"blk": blk, "n": len(i), "dim": v.shape[1], "kind": kind, "ids": i.astype("<i8").tobytes(), "vecs": v.astype(kind).tobytes()}], schema)
                blk += 1

    schema = pa.schema([("blk", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("vecs", pa.binary())])
    held = rows.select(F.col(key).cast("long").alias("id"), "vec").where("id is not null and vec is not null and not exists(vec, x -> x is null)")
    return written(held.mapInArrow(run, PACKED), "packed")


def unpacked(blocks: Iterable[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float64 rows of blocks; shorter vectors are padded with zeros."""
    blocks = list(blocks)
    ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in blocks])
    out = np.zeros((len(ids), max(r["dim"] for r in blocks)))
    at = 0
    for r in blocks:
        out[at : at + r["n"], : r["dim"]] = np.frombuffer(r["vecs"], r["kind"]).reshape(r["n"], r["dim"])
        at += r["n"]
    return ids, out


def dealt(sizes: list[tuple[int, int]], groups: int) -> tuple[list[tuple[int, int]], int]:
    """Blocks (blk, n) in runs of about equal numbers of rows: blk with its group, and how many groups there are."""
    total, before, out = sum(n for _, n in sizes), 0, []
    names: dict[int, int] = {}
    for blk, n in sorted(sizes):
        out.append((blk, names.setdefault(before * groups // total, len(names))))
        before += n
    return out, len(names)


def grid(queries: int, base: int, most_queries: int, most_base: int, wanted: int) -> tuple[int, int]:
    """Groups of queries and of base rows: few enough rows in each, and as many cells as wanted while sides stay long."""
    q, b = -(-queries // most_queries), -(-base // most_base)
    while q * b < wanted:
        if base / b >= queries / q and base / b > LEAST:
            b += 1
        elif queries / q > LEAST and queries / q > base / b:
            q += 1
        else:
            break
    return q, b


def cell_topk(k: int, metric: str, exclude_self: bool, pieces: int):
    def answered(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        sides = [[r for r in rows if r["side"] == x] for x in (0, 1)]
        if not all(sides):
            return
        (qids, queries), (ids, base) = map(unpacked, sides)
        wide = max(queries.shape[1], base.shape[1])
        queries, base = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (queries, base))
        q, i, d = nearest(qids, queries, ids, base, k, metric, exclude_self)
        piece = ((q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % pieces
        order = np.argsort(piece, kind="stable")
        names, starts = np.unique(piece[order], return_index=True)
        for name, at in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), *(pa.array([x[at].tobytes()], pa.binary()) for x in (q, i, d))], ["piece", "q", "i", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["cell"] != r["cell"]:
                    yield from answered(held)
                    held = []
                held.append(r)
        yield from answered(held)

    return run


def merge_topk(k: int):
    def run(table: pa.Table) -> pa.Table:
        q, i, d = (np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()]) for name, kind in (("q", "<i8"), ("i", "<i8"), ("d", "<f8")))
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(q)]]))) + 1
        keep = rank <= k
        return pa.table({"qid": q[keep], "rank": rank[keep].astype(np.int32), "node_id": i[keep], "dist": d[keep]})

    return run


def topk_of(asked: DataFrame, held: DataFrame, k: int, metric: str, exclude_self: bool, block: int) -> DataFrame:
    """exact_topk of packed queries and base."""
    spark = asked.sparkSession
    counts = [[(r["blk"], r["n"], r["dim"] * int(r["kind"][-1])) for r in x.select("blk", "n", "dim", "kind").collect()] for x in (asked, held)]
    if not all(counts):
        return spark.createDataFrame([], OUT)
    wide = [max(1, max(b for _, _, b in x)) for x in counts]
    n_queries, n_base = (sum(n for _, n, _ in x) for x in counts)
    groups = grid(n_queries, n_base, max(1, min(block, BYTES // wide[0])), max(1, min(BASE, BYTES // wide[1])), PER_CORE * spark.sparkContext.defaultParallelism)
    (of_q, gq), (of_b, gb) = (dealt([(blk, n) for blk, n, _ in x], g) for x, g in zip(counts, groups, strict=True))
    sides = []
    for side, (blocks, own, others) in enumerate(((asked, of_q, gb), (held, of_b, gq))):
        named = blocks.join(F.broadcast(spark.createDataFrame(own, "blk long, grp int")), "blk")
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other")
        at = F.col("grp") * gb + F.col("other") if side == 0 else F.col("other") * gb + F.col("grp")
        sides.append(named.select("*", other).select(at.alias("cell"), F.lit(side).alias("side"), "n", "dim", "kind", "ids", "vecs"))
    cells = sides[0].unionAll(sides[1]).repartitionById(gq * gb, F.col("cell")).sortWithinPartitions("cell")
    found = cells.mapInArrow(cell_topk(k, metric, exclude_self, -(-n_queries // PIECE)), "piece int, q binary, i binary, d binary")
    return found.groupBy("piece").applyInArrow(merge_topk(k), OUT)


def exact_topk(queries: DataFrame, base: DataFrame, k: int = 10, metric: str = "l2", exclude_self: bool = True, block: int = BLOCK) -> DataFrame:
    """queries: qid, vec. base: node_id, vec. Returns qid, rank, node_id, dist. block: queries of a cell at most. Rows without id
    or vector take no part."""
    return topk_of(packed(queries, "qid", min(PACK, block)), packed(base, "node_id"), k, metric, exclude_self, block)


def knn_graph(vectors: DataFrame, m: int, metric: str = "l2") -> DataFrame:
    """Directed edges (node_id, slot, nbr, dist) to the m nearest; exact, every row is a query."""
    rows = packed(vectors, "node_id")
    found = topk_of(rows, rows, m, metric, True, BLOCK)
    return found.select(F.col("qid").alias("node_id"), (F.col("rank") - 1).alias("slot"), F.col("node_id").alias("nbr"), "dist")
