"""Private information retrieval from lattices: a matrix scheme in NumPy, and the embedding and neighbour schemes over tables.

Both sides run in one Spark application here, so this shows the algebra and its costs; it protects nothing unless the
client's secrets stay outside the cluster. Secrets are arguments of client functions and are never logged.

A server holds DB and a hint H = DB A, with A public, made from a seed block by block. A query is A s + e + delta * x; the
answer DB (A s + e + delta * x) less H s is delta * DB x plus small noise, from which DB x is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkann.functions.codes import INVALID_PART, RING, delta
from sparkann.operators import ring
from sparkann.operators.knn import as_matrix
from sparkann.operators.layout import Shape
from sparkann.sources.scratch import written

EMBEDDING_P, NEIGHBOUR_P = 1 << 24, 1 << 7
#: Columns of a block of the neighbour database, and queries that one scan of it answers.
COLUMNS, QUERIES = 2048, 512


class SimplePIR:
    """One column of a small matrix of numbers below p, retrieved privately."""

    def __init__(self, db: np.ndarray, params: ring.Params, seed: int = 0):
        if db.min(initial=0) < 0 or db.max(initial=0) >= params.p:
            raise ValueError("entries must be 0 to p - 1")
        self.db, self.params, self.seed = db, params, seed
        self.shared = ring.uniform(db.shape[1], params.n, seed)
        self.hint = ring.multiply(db, self.shared)

    def query(self, column: int, secret: np.ndarray, noise: np.ndarray) -> np.ndarray:
        one = np.zeros(self.db.shape[1], np.int64)
        one[column] = self.params.delta
        return (ring.multiply(self.shared, secret).astype(np.int64) + noise + one).astype(np.uint32)

    def answer(self, query: np.ndarray) -> np.ndarray:
        return ring.multiply(self.db, query)

    def recover(self, answer: np.ndarray, secret: np.ndarray) -> np.ndarray:
        return ring.round_to_plain(answer - ring.multiply(self.hint, secret), self.params.p)


@dataclass(frozen=True)
class EmbeddingScheme:
    """Inner products of a query with all members of one cluster, without telling which."""

    clusters: int
    dim: int
    n: int = 1024
    seed: int = 0
    p: int = EMBEDDING_P
    sigma: float = ring.SIGMA

    def shared(self, cluster: int) -> np.ndarray:
        """The cluster's rows of A."""
        return ring.uniform(self.dim, self.n, self.seed, cluster)

    def expected_noise(self, norm: float) -> float:
        """Standard deviation of the noise in an inner product, for a row of that norm."""
        return self.sigma * norm / delta(self.p)


def hints(rows: DataFrame, scheme: EmbeddingScheme) -> DataFrame:
    """local_idx, hint: H = DB A, one row for each place in a cluster. rows: cluster, local_idx, qvec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            cluster, place = (batch[x].to_numpy(zero_copy_only=False) for x in ("cluster", "local_idx"))
            vecs = as_matrix(batch["qvec"]).astype(np.int64)
            for c in np.unique(cluster).tolist():
                at = np.flatnonzero(cluster == c)
                part = ring.multiply(vecs[at], scheme.shared(c))
                for i, h in zip(place[at].tolist(), part, strict=True):
                    total[i] = total[i] + h if i in total else h
        for i, h in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([h.astype("<u4").tobytes()], pa.binary())], ["local_idx", "hint"])

    def add(pdf):
        return pdf.iloc[:1].assign(hint=[sum(np.frombuffer(x, "<u4") for x in pdf["hint"]).astype("<u4").tobytes()])

    parts = rows.select("cluster", F.col("local_idx").cast("int").alias("local_idx"), "qvec").mapInArrow(run, "local_idx int, hint binary")
    return parts.groupBy("local_idx").applyInPandas(add, "local_idx int, hint binary")


def query(scheme: EmbeddingScheme, cluster: int, vec: np.ndarray, secret: np.ndarray, noise_seed: int | None = None, noisy: bool = True) -> np.ndarray:
    """The query's ciphertext, one block for each cluster."""
    e = ring.gaussian(scheme.clusters * scheme.dim, noise_seed, scheme.sigma).reshape(scheme.clusters, -1) if noisy else np.zeros((scheme.clusters, scheme.dim), np.int64)
    out = np.stack([ring.multiply(scheme.shared(c), secret).astype(np.int64) + e[c] for c in range(scheme.clusters)])
    out[cluster] += delta(scheme.p) * vec.astype(np.int64)
    return out.astype(np.uint32)


def answers(rows: DataFrame, ciphertexts: dict[int, np.ndarray]) -> DataFrame:
    """ct, local_idx, answer: each ciphertext against the whole database in one scan. ciphertexts: (clusters, dim) each; a batch
    is bounded by the caller."""
    ids = np.array(list(ciphertexts), np.int64)
    held = np.stack([ciphertexts[i] for i in ids.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, place = (batch[x].to_numpy(zero_copy_only=False) for x in ("cluster", "local_idx"))
            vecs = as_matrix(batch["qvec"]).astype(np.int64)
            for c in np.unique(cluster).tolist():
                at = np.flatnonzero(cluster == c)
                part = ring.multiply(vecs[at], held[:, c].T.astype(np.int64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(at))), pa.array(np.repeat(place[at].astype(np.int32), len(ids))), pa.array(part.ravel())], ["ct", "local_idx", "part"])

    parts = rows.select("cluster", "local_idx", "qvec").mapInArrow(run, "ct long, local_idx int, part long")
    return parts.groupBy("ct", "local_idx").agg(F.pmod(F.sum("part"), F.lit(RING)).alias("answer"))


def recovered(answered: DataFrame, hinted: DataFrame, secrets: dict[int, np.ndarray], p: int = EMBEDDING_P, signed: bool = True, compat: bool = False) -> DataFrame:
    """ct, place, value: the client's side. answered: ct, place, answer; hinted: place, hint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ct, answer = (batch[x].to_numpy(zero_copy_only=False) for x in ("ct", "answer"))
            mask = np.array([int(ring.multiply(np.frombuffer(h, "<u4")[None], secrets[c])[0]) for h, c in zip(batch["hint"].to_pylist(), ct.tolist(), strict=True)], np.int64)
            diff = ((answer - mask) % RING).astype(np.uint32)
            value = ring.recover_signed(diff, p, compat) if signed else ring.round_to_plain(diff, p)
            yield pa.RecordBatch.from_arrays([batch["ct"], batch["place"], pa.array(value.astype(np.int64))], ["ct", "place", "value"])

    return answered.join(hinted, "place").select("ct", "place", "answer", "hint").mapInArrow(run, "ct long, place int, value long")


def private_products(rows: DataFrame, scheme: EmbeddingScheme, wanted: list[tuple[int, int, np.ndarray]], hinted: DataFrame | None = None, seed: int | None = None, noisy: bool = True, compat: bool = False) -> DataFrame:
    """ct, local_idx, value: inner products for wanted (ct, cluster, vector), retrieved through the scheme."""
    own = {ct: ring.secret(scheme.n, None if seed is None else seed * 1_000_003 + ct) for ct, _, _ in wanted}
    sent = {ct: query(scheme, c, v, own[ct], None if seed is None else seed * 1_000_003 + ct, noisy) for ct, c, v in wanted}
    hinted = (hinted if hinted is not None else hints(rows, scheme)).withColumnRenamed("local_idx", "place")
    answered = answers(rows, sent).withColumnRenamed("local_idx", "place")
    return recovered(answered, hinted, own, scheme.p, True, compat).withColumnRenamed("place", "local_idx")


@dataclass(frozen=True)
class NeighbourScheme:
    """One column of the neighbour database, the encoded neighbours of a subgroup, without telling which."""

    sizes: Shape
    n: int = 1024
    seed: int = 0
    p: int = NEIGHBOUR_P
    sigma: float = ring.SIGMA
    block: int = COLUMNS

    def shared(self) -> np.ndarray:
        """A, one row for each column of the database: the index's size, not the data's."""
        return ring.uniform(self.sizes.columns, self.n, self.seed)

    def shared_blocks(self) -> Iterator[np.ndarray]:
        """The rows of A, a block at a time, without holding all of them."""
        rng = np.random.default_rng([self.seed])
        for at in range(0, self.sizes.columns, self.block):
            yield rng.integers(0, RING, (min(self.block, self.sizes.columns - at), self.n), dtype=np.uint32)

    def checked(self, column: int) -> int:
        if not 0 <= column < self.sizes.columns:
            raise ValueError(f"no column {column} among {self.sizes.columns}")
        return column

    def query(self, column: int, secret: np.ndarray, noise_seed: int | None = None) -> np.ndarray:
        out = ring.multiply(self.shared(), secret).astype(np.int64) + ring.gaussian(self.sizes.columns, noise_seed, self.sigma)
        out[self.checked(column)] += delta(self.p)
        return out.astype(np.uint32)

    def queries(self, columns: np.ndarray, secrets: np.ndarray, noise: np.ndarray) -> Iterator[np.ndarray]:
        """The queries of many columns, a block of the database's columns at a time: (block, queries) each. secrets: (n, queries);
        noise: (columns, queries)."""
        at = 0
        for shared in self.shared_blocks():
            part = ring.multiply(shared, secrets).astype(np.int64) + noise[at : at + len(shared)]
            mine = np.flatnonzero((columns >= at) & (columns < at + len(shared)))
            part[columns[mine] - at, mine] += delta(self.p)
            yield part.astype(np.uint32)
            at += len(shared)


def database(cells: DataFrame, scheme: NeighbourScheme) -> DataFrame:
    """part, data: the neighbour database in written blocks of columns, a byte a cell. Cells that are not there hold INVALID_PART; a
    block with none at all is left out."""
    rows, columns, block = scheme.sizes.rows, scheme.sizes.columns, scheme.block

    def pack(table: pa.Table) -> pa.Table:
        column, row, value = (table[x].to_numpy() for x in ("sg_col", "row", "value"))
        part = int(column[0]) // block
        held = np.full((rows, min(block, columns - part * block)), INVALID_PART, np.uint8)
        held[row, column - part * block] = value
        return pa.table({"part": pa.array([part], pa.int32()), "data": pa.array([held.tobytes()], pa.binary())})

    held = cells.select(F.floor(F.col("sg_col") / block).cast("int").alias("part"), "sg_col", "row", "value")
    return written(held.groupBy("part").applyInArrow(pack, "part int, data binary"), "database")


def block_of(data: bytes | None, rows: int, width: int) -> np.ndarray:
    return np.full((rows, width), INVALID_PART, np.uint8) if data is None else np.frombuffer(data, np.uint8).reshape(rows, width)


def neighbour_hints(db: DataFrame, scheme: NeighbourScheme) -> DataFrame:
    """place, hint: one row for each row of the database (as from database())."""
    rows, n = scheme.sizes.rows, scheme.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {r["part"]: r["data"] for r in batch.to_pylist()}
            for part, shared in enumerate(scheme.shared_blocks()):
                if part in held:
                    total = ring.multiply(block_of(held[part], rows, len(shared)), shared).astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), pa.array([h.tobytes() for h in total], pa.binary())], ["place", "hint"])

    def add(pdf):
        return pdf.iloc[:1].assign(hint=[np.sum([np.frombuffer(x, "<u4") for x in pdf["hint"]], axis=0, dtype=np.uint32).astype("<u4").tobytes()])

    spark = db.sparkSession
    there = {r["part"] for r in db.select("part").collect()}
    lost = np.zeros(n, np.uint32)  # of blocks that are left out, alike for all rows
    if len(there) < -(-scheme.sizes.columns // scheme.block):
        for part, shared in enumerate(scheme.shared_blocks()):
            lost += np.uint32(0) if part in there else shared.sum(axis=0, dtype=np.uint32) * np.uint32(INVALID_PART)
    empty = spark.range(rows).select(F.col("id").cast("int").alias("place"), F.lit(bytearray(lost.astype("<u4").tobytes())).alias("hint"))
    return db.mapInArrow(run, "place int, hint binary").unionByName(empty).groupBy("place").applyInPandas(add, "place int, hint binary")


def private_columns(db: DataFrame, scheme: NeighbourScheme, wanted: dict[int, int] | DataFrame, hinted: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """ct, place, value: columns (ct: column, or a table of them) of the neighbour database, retrieved through the scheme; exact.
    db: as from database(), or cells. A task makes a block of queries, answers them in one scan and recovers; it holds the database, a
    byte a cell, and the noise of its queries. Secrets stay in the task."""
    spark, rows, columns, n = db.sparkSession, scheme.sizes.rows, scheme.sizes.columns, scheme.n
    db = db if "data" in db.columns else database(db, scheme)
    if isinstance(wanted, dict):
        wanted = spark.createDataFrame([(ct, scheme.checked(column)) for ct, column in wanted.items()], "ct long, column int")
    hinted = hinted if hinted is not None else neighbour_hints(db, scheme)
    hint = np.stack([np.frombuffer(r["hint"], "<u4") for r in hinted.orderBy("place").collect()])  # the database's rows, not its columns
    blocks = max(1, -(-wanted.count() // QUERIES))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        ct, column = (asked[x].to_numpy() for x in ("ct", "column"))
        seeds = [None if seed is None else seed * 1_000_003 + x for x in ct.tolist()]
        for x in column.tolist():
            scheme.checked(x)
        secrets = np.stack([ring.secret(n, s) for s in seeds], axis=1) if len(ct) else np.zeros((n, 0), np.uint32)
        noise = np.stack([ring.gaussian(columns, s, scheme.sigma).astype(np.int8) for s in seeds], axis=1) if len(ct) else np.zeros((columns, 0), np.int8)
        data = dict(zip(held["part"].to_pylist(), held["data"].to_pylist(), strict=True))
        answer = np.zeros((rows, len(ct)), np.uint32)
        for part, sent in enumerate(scheme.queries(column, secrets, noise)):
            answer += ring.multiply(block_of(data.get(part), rows, len(sent)), sent)
        value = ring.round_to_plain(answer - ring.multiply(hint, secrets), scheme.p)
        return pa.table({"ct": np.tile(ct, rows), "place": np.repeat(np.arange(rows, dtype=np.int32), len(ct)), "value": value.ravel()})

    asked = wanted.select("ct", F.col("column").cast("int").alias("column"), F.pmod(F.col("ct"), F.lit(blocks)).cast("int").alias("blk"))
    scans = db.select("part", "data", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
    return asked.groupBy("blk").cogroup(scans.groupBy("blk")).applyInArrow(run, "ct long, place int, value long")


def column_parts(values: DataFrame, sizes: Shape) -> DataFrame:
    """ct, idx_in_sg, slot, parts from a retrieved column."""
    part, slot = F.col("place") % sizes.parts, F.floor(F.col("place") / sizes.parts) % sizes.max_neighbours
    place = F.floor(F.col("place") / (sizes.parts * sizes.max_neighbours)).cast("int")
    held = values.select("ct", place.alias("idx_in_sg"), slot.cast("int").alias("slot"), F.struct(part.alias("i"), F.col("value").cast("int").alias("v")).alias("s"))
    return held.groupBy("ct", "idx_in_sg", "slot").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("parts"))
