"""Vector expressions as Columns, and the same as SQL functions of a session.

Integer vectors give exact integers; other vectors are computed in double precision. Vectors of different lengths have no
distance (null), as have vectors that hold a null.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EPSILON = 1e-10  # under the root of a norm, so that a zero vector can be divided by it
METRICS = ("l2", "ip", "cosine")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(array: Column, kind: str = "double") -> Column:
    return F.aggregate(array, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind))


def dot(a: Column | str, b: Column | str, kind: str = "double") -> Column:
    """Inner product; kind "long" for integer vectors."""
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast(kind) * y.cast(kind)), kind)


def l2_squared(a: Column | str, b: Column | str, kind: str = "double") -> Column:
    return total(F.transform(F.zip_with(col(a), col(b), lambda x, y: x.cast(kind) - y.cast(kind)), lambda d: d * d), kind)


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(col(v), lambda x: x.cast("double") * x.cast("double"))) + EPSILON)


def normalized(v: Column | str) -> Column:
    length = norm(v)
    return F.get(F.transform(F.array(length), lambda n: F.transform(col(v), lambda x: x.cast("double") / n)), F.lit(0))


def distance(a: Column | str, b: Column | str, metric: str = "l2", kind: str = "double") -> Column:
    """Smaller is nearer: squared L2, the negated inner product, or one less the cosine."""
    if metric == "l2":
        return l2_squared(a, b, kind)
    if metric == "ip":
        return -dot(a, b, kind)
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    raise ValueError(f"no metric {metric!r}; there are {', '.join(METRICS)}")


#: name: (arguments, what it returns, SQL). Bound by register() to a session.
SQL_FUNCTIONS = {
    "vec_ip": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_ip_int": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "BIGINT", "aggregate(zip_with(a, b, (x, y) -> x * y), 0L, (s, x) -> s + x)"),
    "vec_l2sq": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "vec_l2sq_int": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "BIGINT", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0L, (s, x) -> s + x)"),
    "vec_norm": ("v ARRAY<DOUBLE>", "DOUBLE", f"sqrt(aggregate(v, 0D, (s, x) -> s + x * x) + {EPSILON}D)"),
    "vec_normalize": ("v ARRAY<DOUBLE>", "ARRAY<DOUBLE>", f"transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y) + {EPSILON}D))"),
    "vec_quantize": ("v ARRAY<DOUBLE>, scale DOUBLE, lo INT, hi INT", "ARRAY<SMALLINT>", "transform(v, x -> CAST(greatest(lo, least(hi, round(x * scale))) AS SMALLINT))"),
    "pir_delta": ("logq INT, p BIGINT", "BIGINT", "CAST(pow(2, logq) AS BIGINT) div p"),
    "pir_round": ("x BIGINT, delta BIGINT, p BIGINT", "BIGINT", "((x + delta div 2) div delta) % p"),
    "pir_recover_signed": ("ans BIGINT, hs BIGINT, delta BIGINT", "BIGINT", "floor((CASE WHEN pmod(ans - hs, 4294967296) >= 2147483648 THEN pmod(ans - hs, 4294967296) - 4294967296 ELSE pmod(ans - hs, 4294967296) END + delta div 2) / delta)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the SQL functions known to a session; returns their names."""
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)
