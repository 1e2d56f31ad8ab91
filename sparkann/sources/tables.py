"""Text tables, id maps, saved indexes, stages that resume, and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkann.functions.quantizer import Quantizer
from sparkann.operators.evaluate import render

VERSION = 1
TABLES = ("vectors", "nodes", "edges", "layout", "neighbour_groups", "centroids")


# --- text -----------------------------------------------------------------------------------------------------------


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, pid, rel of judgments above 0; fields are parted by white space."""
    part = F.split(F.trim("value"), r"\s+")
    held = spark.read.text(path).where(F.size(part) >= 4)
    return held.select(part[0].cast("long").alias("qid"), part[2].cast("long").alias("pid"), part[3].cast("int").alias("rel")).where("rel > 0")


def read_texts(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """An id and the text after the first tab."""
    at = F.instr("value", "\t")
    held = spark.read.text(path).where(at > 0)
    return held.select(F.substring("value", F.lit(1), at - 1).cast("long").alias(name), F.substring("value", at + 1, F.length("value")).alias("text"))


def id_map(df: DataFrame, key: str) -> DataFrame:
    """key, idx: ids in order, numbered from 0. Numbers are places within ranges plus the rows of ranges before, so no task
    sees all ids."""
    spark = df.sparkSession
    ranged = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    from sparkann.sources.scratch import written

    held = written(ranged.withColumn("part", F.spark_partition_id()), "ids")
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return held.withColumn("nth", nth).join(F.broadcast(before), "part").select(key, (F.col("before") + F.col("nth") - 1).alias("idx"))


def embed(texts: DataFrame, encoder: Callable[[list[str]], Iterable[Iterable[float]]], key: str = "id", batch: int = 256) -> DataFrame:
    """key, vec: texts through an encoder, batch by batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch]
                yield pd.DataFrame({key: own[key], "vec": [[float(x) for x in v] for v in encoder(own["text"].fillna("").tolist())]})

    return texts.select(key, "text").mapInPandas(run, f"{key} long, vec array<float>")


# --- saved tables ---------------------------------------------------------------------------------------------------


def _put_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _get_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table at path is complete."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(held)


def save_index(path: str, quantizer: Quantizer, metric: str, **tables: DataFrame) -> None:
    """Tables as Parquet beside metadata; metadata goes last, so what has it is whole."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"an index has no table {', '.join(sorted(unknown))}")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    _put_json(spark, f"{path}/metadata", {"version": VERSION, "metric": metric, "quantizer": quantizer.to_json(), "tables": {n: df.schema.jsonValue() for n, df in tables.items()}})


def load_index(spark: SparkSession, path: str) -> tuple[Quantizer, str, dict[str, DataFrame]]:
    """Quantizer, metric and tables; a version or a schema that isn't what was saved is an error."""
    if not exists(spark, f"{path}/metadata"):
        raise ValueError(f"{path} holds no whole index")
    held = _get_json(spark, f"{path}/metadata")
    if held["version"] != VERSION:
        raise ValueError(f"{path} has version {held['version']}; this reads {VERSION}")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in held["tables"]}
    for n, df in tables.items():
        if [f.name for f in df.schema.fields] != [f["name"] for f in held["tables"][n]["fields"]]:
            raise ValueError(f"{path}/{n} isn't the table that was saved")
    return Quantizer.from_json(held["quantizer"]), held["metric"], tables


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], key: str = "", resume: bool = True) -> DataFrame:
    """A step's table: read if it is there, whole and made under the same key (a name of its inputs), else made and written."""
    if resume and exists(spark, path) and exists(spark, f"{path}.key") and _get_json(spark, f"{path}.key")["key"] == key:
        return spark.read.parquet(path)
    make().write.mode("overwrite").parquet(path)
    _put_json(spark, f"{path}.key", {"key": key})
    return spark.read.parquet(path)


def write_report(stats: DataFrame, path: str, report: dict, title: str = "report") -> str:
    """Statistics by query as Parquet, the report as text beside them; returns the text."""
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    text = render(report, title)
    stats.sparkSession.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return text
