"""Written tables in the folder that driver and executors share; they end lineage and outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder of its own, as in tests on one machine.
LOCAL_SCRATCH = "/tmp/checkpoints/sparkann"


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or LOCAL_SCRATCH).rstrip("/")


def written(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """Write df as Parquet and read it back: a lost executor costs only its own unfinished tasks. The table stays until the
    folder's owner removes it."""
    spark = df.sparkSession
    path = path or f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
