"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkann.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """u with the least of u and its neighbours. Minima are partial before the shuffle; as the result is a table of its own,
    a join to it shuffles both sides, and a node with very many neighbours can be split among tasks."""
    return written(edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = _least(edges)
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root: every linked node with the least node it can reach, itself included.
    Each round ends in a written table, so that a lost executor costs no more than the round."""
    edges = _settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    edges = written(edges, "links")
    state = _state(edges)
    while True:
        edges = written(_settled(_small_star(_settled(_large_star(edges)))), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
