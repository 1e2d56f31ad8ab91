"""Shared helpers: the scratch folder that all executors see, written tables and Arrow access."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no folder of its own, as in tests on one machine.
LOCAL_SCRATCH = "/tmp/checkpoints/sparkann"


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or LOCAL_SCRATCH).rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet to the scratch folder and read it back: lineage ends there, and a lost executor costs only its
    own unfinished tasks. The table stays until the folder's owner removes it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> F.Column:
    """All columns as one struct, row, which no other name can clash with."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def unpacked_rows(df: DataFrame, **changed: F.Column) -> DataFrame:
    """The columns of the struct row again, some of them changed."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in df.schema["row"].dataType.names))


def with_row(schema: str, df: DataFrame) -> T.StructType:
    """A schema with df's struct row added."""
    return T.StructType([*T.StructType.fromDDL(schema).fields, df.schema["row"]])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def shuffle_partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)


def key128(column) -> F.Column:
    """16 bytes that stand for a text (MD5 of its UTF-8 bytes); null counts as empty."""
    return F.unhex(F.md5(F.coalesce(column, F.lit("")).cast("binary")))
