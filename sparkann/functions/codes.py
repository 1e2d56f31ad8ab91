"""Integer codes: neighbour ids in small parts, digits in a base, scaled ring elements, and the sizes that follow."""

from __future__ import annotations

from math import ceil, isqrt, log2, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = 1 << 32
PART_BITS, INVALID_PART = 7, 127


def bits_for(n: int) -> int:
    """Bits that tell n + 1 values apart."""
    return max(1, ceil(log2(n + 1)))


def parts_for(bits: int) -> int:
    return -(-bits // PART_BITS)


def pack_id(cluster: Column, local: Column, local_bits: int) -> Column:
    return F.shiftleft(cluster.cast("long"), local_bits).bitwiseOR(local.cast("long"))


def unpack_id(code: Column, local_bits: int) -> tuple[Column, Column]:
    """cluster and local index of a packed id."""
    return F.shiftright(code, local_bits).cast("int"), code.bitwiseAND(F.lit((1 << local_bits) - 1)).cast("int")


def split_parts(code: Column, parts: int) -> Column:
    """Seven bits each, low ones first."""
    return F.array(*(F.shiftright(code, PART_BITS * p).bitwiseAND(F.lit(INVALID_PART)).cast("int") for p in range(parts)))


def join_parts(parts: Column) -> Column:
    """The packed id; null where every part says invalid."""
    code = F.aggregate(F.zip_with(parts, F.sequence(F.lit(0), F.size(parts) - 1), lambda x, i: F.when(x.isNotNull(), F.call_function("shiftleft", x.cast("long"), i * PART_BITS))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.when(~F.forall(parts, lambda x: x == INVALID_PART), code)


def base_digits(value: Column, base: int, digits: int) -> Column:
    """Digits in a base, low ones first."""
    return F.array(*(F.pmod(F.floor(value / F.lit(base**i)), F.lit(base)).cast("long") for i in range(digits)))


def from_base_digits(digits: Column, base: int) -> Column:
    return F.aggregate(F.reverse(digits), F.lit(0).cast("long"), lambda s, d: s * base + d)


def digits_in_base(bits: int, base: int) -> int:
    """Digits in base that hold a number of that many bits."""
    return ceil(bits / log2(base))


def delta(p: int, logq: int = 32) -> int:
    return (1 << logq) // p


def rounded(x: Column, p: int, logq: int = 32) -> Column:
    """The plaintext next to a ring element."""
    d = delta(p, logq)
    return F.pmod(F.floor((x + d // 2) / F.lit(d)), F.lit(p)).cast("long")


def recover_signed(answer: Column, hint: Column, p: int = 1 << 24, compat: bool = False) -> Column:
    """A signed value from an answer less its hint. compat: divide towards zero, so that exact negatives come out one higher."""
    d = delta(p)
    off = F.pmod(answer - hint, F.lit(RING))
    signed = F.when(off >= RING // 2, off - RING).otherwise(off) + d // 2
    whole = F.floor(signed / F.lit(d))
    if compat:
        whole = F.when(signed < 0, F.ceil(signed / F.lit(d))).otherwise(whole)
    return whole.cast("long")


def recover_unsigned(answer: Column, hint: Column, p: int) -> Column:
    return rounded(F.pmod(answer - hint, F.lit(RING)), p)


def recover_clamped(answer: Column, hint: Column, p: int) -> Column:
    """A signed value, held within 0 and p - 1."""
    return F.greatest(F.lit(0), F.least(F.lit(p - 1), recover_signed(answer, hint, p)))


def hnsw_level(u: Column, m: int, most: int = 15) -> Column:
    """Level of a node from a number in (0, 1]."""
    return F.least(F.lit(most), F.floor(-F.ln(u) / F.ln(F.lit(float(m))))).cast("int")


def uniform(*columns: Column) -> Column:
    """A number in (0, 1] from a hash of columns, the same wherever it is computed."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) + 1) / float(1 << 53)


def auto_clusters(n: int, dim: int) -> int:
    return max(1, isqrt(n // max(1, dim)))


def optimal_clusters(n: int, dim: int, alpha: float, beta: float, gamma: float) -> int:
    return max(1, int(sqrt(n * gamma * (1 + (alpha + 1) * beta) / (dim + 1))))


def balanced_clusters(n: int, dim: int) -> int:
    return max(10, min(max(10, n // 100), int(sqrt(n / (dim + 1)))))


def subgroup_size(n: int, m: int, parts: int, least: int = 120) -> int:
    return max(least, int(sqrt(n / (2 * m * parts))))


def prune_factor(average_size: int, is_unsigned: bool) -> float:
    """Share of the best centroid's score that a cluster must reach. Fixed values, by average cluster size."""
    large, medium, small = (0.78, 0.82, 0.85) if is_unsigned else (0.65, 0.50, 0.80)
    return large if average_size > 20_000 else medium if average_size > 5_000 else small


def traffic(clusters: int, dim: int, largest_cluster: int, subgroup_columns: int, neighbour_rows: int, lwe: int = 1024, word: int = 4) -> dict[str, int]:
    """Bytes of hints, queries and answers."""
    return {
        "embedding_hint_bytes": word * largest_cluster * lwe,
        "embedding_query_bytes": word * clusters * dim,
        "embedding_answer_bytes": word * largest_cluster,
        "neighbour_hint_bytes": word * neighbour_rows * lwe,
        "neighbour_query_bytes": word * subgroup_columns,
        "neighbour_answer_bytes": word * neighbour_rows,
    }
