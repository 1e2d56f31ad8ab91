"""Recall, reciprocal rank, summaries, traffic and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkann.functions.codes import traffic
from sparkann.operators.layout import Shape


def hits(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, rank, node_id of results that are among the first k truths; a node counts once."""
    held = results.where(F.col("rank") <= k).groupBy("qid", "node_id").agg(F.min("rank").alias("rank"))
    return held.join(truth.where(F.col("rank") <= k).select("qid", "node_id").distinct(), ["qid", "node_id"], "left_semi")


def recall(results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries (with a truth), hits and recall over all truths within k."""
    asked = truth.where(F.col("rank") <= k).agg(F.count_distinct("qid").alias("queries"), F.count_distinct("qid", "node_id").alias("truths"))
    got = hits(results, truth, k).agg(F.count("*").alias("hits"))
    return asked.join(got, F.lit(True)).withColumn("recall", F.col("hits") / F.col("truths"))


def reciprocal_ranks(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """qid, rr for each query of relevant (qid, node_id): 1 / rank of the first relevant result within k, else 0."""
    first = results.where(F.col("rank") <= k).join(relevant.select("qid", "node_id").distinct(), ["qid", "node_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    return relevant.select("qid").distinct().join(first, "qid", "left").select("qid", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def label_ranks(results: DataFrame, assignment: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """reciprocal_ranks where all other rows of the query's cluster are relevant. assignment: node_id, cluster; asked: qid. Only results
    are compared; that a query has relevant rows at all is seen from the size of its cluster."""
    of_q = asked.distinct().join(assignment.select(F.col("node_id").alias("qid"), F.col("cluster").alias("own")), "qid")
    sizes = assignment.groupBy(F.col("cluster").alias("own")).agg(F.count_distinct("node_id").alias("n"))
    judged = of_q.join(sizes, "own").where("n > 1").select("qid", "own")
    of_node = assignment.select("node_id", F.col("cluster").alias("own"))
    held = results.where((F.col("rank") <= k) & (F.col("qid") != F.col("node_id")))
    first = held.join(judged, "qid").join(of_node, ["node_id", "own"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    return judged.select("qid").distinct().join(first, "qid", "left").select("qid", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def mrr(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    return reciprocal_ranks(results, relevant, k).agg(F.count("*").alias("queries"), F.avg("rr").alias("mrr"))


def relevance_by_id(qrels: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, node_id from judgments (qid, pid, rel) by explicit id maps (pid, idx) and (qid, idx); rel > 0 only."""
    held = qrels.where("rel > 0").join(passages.select("pid", F.col("idx").alias("node_id")), "pid")
    return held.join(queries.select("qid", F.col("idx").alias("q")), "qid").select(F.col("q").alias("qid"), "node_id")


def summary(stats: DataFrame, *columns: str) -> DataFrame:
    """field, average, least, greatest, median of each column."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")
    return stats.select(rows).groupBy("s.field").agg(F.avg("s.x").alias("average"), F.min("s.x").alias("least"), F.max("s.x").alias("greatest"), F.median("s.x").alias("median"))


def moving_average(values: list[float], alpha: float = 0.3) -> float:
    """Exponential, begun with the first value."""
    out = 0.0
    for i, v in enumerate(values):
        out = v if i == 0 else alpha * v + (1 - alpha) * out
    return out


def communication(sizes: Shape, dim: int, embedding_queries: int, neighbour_queries: int, lwe: int = 1024) -> dict[str, int]:
    """Bytes a query sends and gets, and bytes of the hints that are fetched once."""
    t = traffic(sizes.clusters, dim, sizes.largest_cluster, sizes.columns, sizes.rows, lwe)
    up = embedding_queries * t["embedding_query_bytes"] + neighbour_queries * t["neighbour_query_bytes"]
    down = embedding_queries * t["embedding_answer_bytes"] + neighbour_queries * t["neighbour_answer_bytes"]
    return {"up_bytes": up, "down_bytes": down, "hint_bytes": t["embedding_hint_bytes"] + t["neighbour_hint_bytes"], **t}


def index_report(n: int, dim: int, bits: int = 8) -> dict[str, float]:
    """Storage of floats against quantized vectors."""
    raw, held = 4.0 * n * dim, n * dim * bits / 8
    return {"float_bytes": raw, "quantized_bytes": held, "ratio": raw / held if held else 0.0, "saving_percent": 100 * (1 - held / raw) if raw else 0.0}


def describe(**tables: DataFrame) -> dict[str, dict]:
    """Columns and row counts of an index's tables."""
    return {name: {"rows": df.count(), "columns": dict(df.dtypes)} for name, df in tables.items()}


def message_bytes(messages: DataFrame, *columns: str) -> DataFrame:
    """Sum of the lengths of binary columns."""
    return messages.agg(*(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"{c}_bytes") for c in columns))


def render(report: dict, title: str = "report") -> str:
    return "\n".join([title, *(f"  {k:<28}{v:,.3f}" if isinstance(v, float) else f"  {k:<28}{v}" for k, v in report.items())])
