"""Linear algebra modulo 2^32 (or 2^64) in NumPy blocks and over tables of blocks."""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkann.functions.codes import delta

SIGMA, TAIL = 6.4, 33  # of the error distribution
#: Products of a multiplication from which it goes by halves.
HALVED = 1 << 16
BLOCKS = "row_blk int, col_blk int, rows int, cols int, data binary"


@dataclass(frozen=True)
class Params:
    """Learning-with-errors parameters: secret length n, noise, rows l and columns m, modulus 2^logq, plaintexts below p."""

    n: int = 1024
    sigma: float = SIGMA
    l: int = 0
    m: int = 0
    logq: int = 32
    p: int = 991

    @property
    def delta(self) -> int:
        return delta(self.p, self.logq)

    @staticmethod
    def pick(m: int, n: int = 1024, l: int = 0) -> Params:
        """Plaintext moduli for 1,024 secrets and few samples. Fixed values."""
        return Params(n=n, l=l, m=m, p=991 if m <= 1 << 13 else 929 if m <= 1 << 14 else 991)


def word(logq: int) -> type:
    return np.uint32 if logq == 32 else np.uint64


def multiply(a: np.ndarray, b: np.ndarray, logq: int = 32) -> np.ndarray:
    """a @ b modulo 2^logq. Signed entries count modulo 2^logq. 32-bit products are summed in 64 bits, exactly modulo 2^32."""
    a, b = np.asarray(a), np.asarray(b)
    if logq == 32 and a.ndim == 2 and a.size * (b.size // max(1, a.shape[1])) > HALVED and a.shape[1] <= 1 << 20:
        return by_halves(a, b)
    kind = np.uint64
    product = a.astype(np.int64).astype(kind) @ b.astype(np.int64).astype(kind) if a.dtype.kind == "i" or b.dtype.kind == "i" else a.astype(kind) @ b.astype(kind)
    return product.astype(word(logq))


def by_halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same modulo 2^32 by matrix products of 16-bit halves as doubles: sums of up to 2^20 products of halves are exact."""
    (a_low, a_high), (b_low, b_high) = ((x & np.uint32(0xFFFF), x >> np.uint32(16)) for x in (a.astype(np.uint32), b.astype(np.uint32)))
    a_low, b_low = a_low.astype(np.float64), b_low.astype(np.float64)
    out, high = a_low @ b_low, a_low @ b_high.astype(np.float64)
    if a_high.any():
        high += a_high.astype(np.float64) @ b_low
    return (out.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(16))).astype(np.uint32)


def round_to_plain(x: np.ndarray, p: int, logq: int = 32) -> np.ndarray:
    d = delta(p, logq)
    return (((x.astype(object) if logq == 64 else x.astype(np.uint64)) + d // 2) // d % p).astype(np.int64)


def recover_signed(diff: np.ndarray, p: int, compat: bool = False) -> np.ndarray:
    """Signed plaintexts from differences modulo 2^32. compat: divide towards zero."""
    d = delta(p)
    signed = diff.astype(np.uint32).astype(np.int32).astype(np.int64) + d // 2
    return np.where(signed < 0, -(-signed // d), signed // d) if compat else signed // d


def uniform(rows: int, cols: int, seed: int, *more: int, logq: int = 32) -> np.ndarray:
    """A public matrix that both sides can make from a seed."""
    return np.random.default_rng([seed, *more]).integers(0, 1 << logq, (rows, cols), dtype=word(logq))


def secret(n: int, seed: int | None = None, logq: int = 32) -> np.ndarray:
    """A secret; without a seed (tests give one) from the system's generator."""
    if seed is None:
        return np.frombuffer(secrets.token_bytes(n * logq // 8), word(logq)).copy()
    return np.random.default_rng([seed, 1]).integers(0, 1 << logq, n, dtype=word(logq))


def gaussian(n: int, seed: int | None = None, sigma: float = SIGMA, tail: int = TAIL) -> np.ndarray:
    """Discrete Gaussian by rejection, within -tail to tail."""
    rng = np.random.default_rng(secrets.randbits(128) if seed is None else [seed, 2])
    out = np.zeros(0, np.int64)
    while len(out) < n:
        x = rng.integers(-tail, tail + 1, 4 * n + 16)
        out = np.concatenate([out, x[rng.random(len(x)) < np.exp(-(x * x) / (2 * sigma * sigma))]])
    return out[:n]


def squish(matrix: np.ndarray, basis: int = 10, each: int = 3) -> np.ndarray:
    """Each few neighbouring entries of a row, basis bits each, in one 32-bit word."""
    rows, cols = matrix.shape
    padded = np.zeros((rows, -(-cols // each) * each), np.uint32)
    padded[:, :cols] = matrix
    return sum(padded[:, i::each] << np.uint32(basis * i) for i in range(each))


def unsquish(packed: np.ndarray, cols: int, basis: int = 10, each: int = 3) -> np.ndarray:
    out = np.zeros((packed.shape[0], packed.shape[1] * each), np.uint32)
    for i in range(each):
        out[:, i::each] = packed >> np.uint32(basis * i) & np.uint32((1 << basis) - 1)
    return out[:, :cols]


# --- tables of blocks -----------------------------------------------------------------------------------------------


def to_blocks(spark, matrix: np.ndarray, size: int = 512) -> DataFrame:
    rows = [(i // size, j // size, *(b := matrix[i : i + size, j : j + size]).shape, bytearray(np.ascontiguousarray(b, "<u4").tobytes())) for i in range(0, matrix.shape[0], size) for j in range(0, matrix.shape[1], size)]
    return spark.createDataFrame(rows, BLOCKS)


def from_blocks(blocks: DataFrame) -> np.ndarray:
    """The whole matrix; for results that fit the driver."""
    held = {(r["row_blk"], r["col_blk"]): np.frombuffer(bytes(r["data"]), "<u4").reshape(r["rows"], r["cols"]) for r in blocks.collect()}
    if not held:
        return np.zeros((0, 0), np.uint32)
    return np.block([[held[i, j] for j in sorted({c for _, c in held})] for i in sorted({r for r, _ in held})])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            a = np.frombuffer(r["a"], "<u4").reshape(r["n"], r["k"])
            b = np.frombuffer(r["b"], "<u4").reshape(r["k"], r["m"])
            rows.append((r["row_blk"], r["col_blk"], r["n"], r["m"], multiply(a, b).astype("<u4").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["row_blk", "col_blk", "rows", "cols", "data"])


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<u4") for x in pdf["data"])
    return pdf.iloc[:1].assign(data=[total.astype("<u4").tobytes()])


def multiply_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two tables of blocks modulo 2^32: blocks meet on the inner index, products are summed by place."""
    left = a.select(F.col("row_blk"), F.col("col_blk").alias("k_blk"), F.col("rows").alias("n"), F.col("cols").alias("k"), F.col("data").alias("a"))
    right = b.select(F.col("row_blk").alias("k_blk"), F.col("col_blk"), F.col("cols").alias("m"), F.col("data").alias("b"))
    parts = left.join(right, "k_blk").select("row_blk", "col_blk", "n", "k", "m", "a", "b").mapInArrow(_products, BLOCKS)
    return parts.groupBy("row_blk", "col_blk").applyInPandas(_sum, BLOCKS)


def _transposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.ascontiguousarray(np.frombuffer(x, "<u4").reshape(n, m).T).tobytes() for x, n, m in zip(batch["data"].to_pylist(), batch["rows"].to_pylist(), batch["cols"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["col_blk"], batch["row_blk"], batch["cols"], batch["rows"], pa.array(data, pa.binary())], ["row_blk", "col_blk", "rows", "cols", "data"])


def transpose_blocks(a: DataFrame) -> DataFrame:
    return a.mapInArrow(_transposed, BLOCKS)


def add_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row_blk", "col_blk").applyInPandas(_sum, BLOCKS)
