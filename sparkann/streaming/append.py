"""Streams of new vectors: quantized with the index's quantizer, routed to clusters, and appended.

The quantizer and the centroids are not trained again, as for any later batch of an index. Batches are written once: each
goes to a folder named by its number, which a batch that runs again replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkann.functions.quantizer import Quantizer
from sparkann.operators.cluster import nearest_centroid


def assigned(vectors: DataFrame, quantizer: Quantizer, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """node_id, qvec, cluster of new vectors (node_id, vec)."""
    held = vectors.select("node_id", quantizer("vec").alias("vec"))
    return nearest_centroid(held, centroids).select("node_id", F.col("vec").alias("qvec"), "cluster")


def append_stream(stream: DataFrame, path: str, checkpoint: str, quantizer: Quantizer, centroids: list[tuple[int, list[float]]], once: bool = True) -> StreamingQuery:
    """Append a stream (node_id, vec) to path, partitioned by batch; read_appended() reads all batches."""

    def batch(df: DataFrame, number: int) -> None:
        assigned(df, quantizer, centroids).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_cluster(stream: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window, cluster, n of a stream with cluster and an event time; rows that come later than allowed are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "cluster").agg(F.count("*").alias("n"))
