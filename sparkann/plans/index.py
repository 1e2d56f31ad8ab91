"""End to end: build an index from vectors, open it, search it, and report."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkann.functions import codes
from sparkann.functions.quantizer import Quantizer, data_range
from sparkann.operators import cluster, evaluate, graph, layout, pir, search
from sparkann.operators.knn import exact_topk
from sparkann.sources import tables
from sparkann.sources.vecs import read_vecs


@dataclass(frozen=True)
class BuildConfig:
    """What an index is built with; 0 clusters or subgroup: by size."""

    m: int = 16
    ef_construction: int = 200
    metric: str = "l2"
    bits: int = 8
    scale: float | None = None
    clusters: int = 0
    method: str = "graph"
    subgroup: int = 0
    bfs: bool = True


def load_vectors(spark: SparkSession, path: str, kind: str | None = None, rows: int | None = None) -> DataFrame:
    """node_id, vec of a vector file."""
    return read_vecs(spark, path, kind, rows).withColumnRenamed("id", "node_id")


def build_index(vectors: DataFrame, path: str, config: BuildConfig | None = None, resume: bool = True) -> dict:
    """Range, graph, clusters, layout, neighbour groups; each step's table stays under path/stages, and a build that is run again
    goes on from the last whole one. Returns the report."""
    config = config or BuildConfig()
    spark = vectors.sparkSession
    step = lambda name, make: tables.stage(spark, f"{path}/stages/{name}", make, str(config), resume)
    held = step("vectors", lambda: vectors.select("node_id", "vec"))
    found = data_range(held, "vec")
    if found["low"] is None:
        raise ValueError("there are no vectors")
    quantizer = Quantizer(config.bits, not found["is_signed"], True, config.scale).fit(held, "vec")
    quantized = step("quantized", lambda: held.select("node_id", quantizer("vec").alias("qvec")))
    nodes = step("nodes", lambda: graph.levels(held, config.m))
    edges = step("edges", lambda: graph.build_graph(held, config.m, config.ef_construction, config.metric)[1])
    ground = edges.where("level = 0").select("node_id", "slot", "nbr")
    n, dim = held.agg(F.count("*"), F.max(F.size("vec"))).first()
    assignment = step("assignment", lambda: cluster.cluster(held, ground, config.method, config.clusters, dim))
    parts = codes.parts_for(codes.bits_for(assignment.agg(F.max("cluster")).first()[0] + 1) + codes.bits_for(n))
    subgroup = config.subgroup or codes.subgroup_size(n, config.m, parts)
    laid = step("layout", lambda: layout.layout(assignment, subgroup, graph.cluster_bfs(assignment, ground) if config.bfs else None))
    groups = step("neighbour_groups", lambda: layout.neighbour_groups(ground, laid))
    centres = step("centroids", lambda: layout.metadata(laid, quantized, quantizer.is_unsigned)["centroids"])
    tables.save_index(path, quantizer, config.metric, vectors=quantized, nodes=nodes, edges=edges, layout=laid, neighbour_groups=groups, centroids=centres)
    stats, cut = cluster.size_stats(assignment).first().asDict(), cluster.edge_cut(ground, assignment).first().asDict()
    return {"nodes": n, "dim": dim, "subgroup": subgroup, **stats, **cut, **evaluate.index_report(n, dim, config.bits)}


@dataclass(frozen=True)
class Index:
    quantizer: Quantizer
    metric: str
    tables: dict[str, DataFrame]

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        index = Index(*tables.load_index(spark, path))
        missing = {"vectors", "edges", "layout", "centroids"} - set(index.tables)
        if missing:
            raise ValueError(f"{path} has no {', '.join(sorted(missing))}: it isn't clustered or laid out")
        return index

    def quantized(self, queries: DataFrame) -> DataFrame:
        """qid, qvec of queries (qid, vec); the dimension must be the index's."""
        dim = self.tables["vectors"].select(F.size("qvec")).first()[0]
        off = queries.where(F.size("vec") != dim).limit(1).collect()
        if off:
            raise ValueError(f"query {off[0]['qid']} hasn't the index's dimension, {dim}")
        return queries.select("qid", self.quantizer("vec").alias("qvec"))

    def search(self, queries: DataFrame, k: int = 10, ef: int = 50, flags: str = "", private: bool = False, lwe: int = 1024, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Results and statistics of queries (qid, vec), plain or through the embedding and neighbour schemes, then padded."""
        t = self.tables
        asked = self.quantized(queries)
        config = search.SearchConfig.from_flags(flags, search.SearchConfig(is_unsigned=self.quantizer.is_unsigned))
        scorer = fetcher = None
        ground = t["edges"].where("level = 0").select("node_id", "slot", "nbr")
        if private:
            members = t["layout"].join(t["vectors"], "node_id")
            dim, clusters = members.select(F.size("qvec")).first()[0], t["layout"].agg(F.max("cluster")).first()[0] + 1
            scorer = search.private_scorer(asked, members, pir.EmbeddingScheme(clusters, dim, n=lwe), seed)
            fetcher = search.private_fetcher(t["layout"], ground, self.shape(), lwe, seed)
            config = replace(config, pad=True)
        return search.routed_search(asked, t["layout"], t["vectors"], ground, t["centroids"], k, ef, config, scorer, fetcher)

    def shape(self) -> layout.Shape:
        laid = self.tables["layout"]
        per_column = laid.agg(F.max("idx_in_sg")).first()[0] + 1
        return layout.shape(laid, per_column, self.tables["edges"].where("level = 0").agg(F.max("slot")).first()[0] + 1)

    def report(self, results: DataFrame, stats: DataFrame, truth: DataFrame, path: str, k: int = 10, relevant: DataFrame | None = None) -> dict:
        """Recall, reciprocal rank (by judgments if there are any, else by the truth), summaries and traffic; written to path."""
        sizes = self.shape()
        first = stats.first()
        dim = self.tables["vectors"].select(F.size("qvec")).first()[0]
        out = {
            "recall": evaluate.recall(results, truth, k).first()["recall"],
            "mrr": evaluate.mrr(results, relevant if relevant is not None else truth.where(F.col("rank") <= k), k).first()["mrr"],
            **{f"{r.field}_{n}": r[n] for r in evaluate.summary(stats, "clusters_fetched", "subgroups_fetched", "nodes_scored").collect() for n in ("average", "median")},
            "round_trips": first["round_trips"],
            **evaluate.communication(sizes, dim, first["embedding_requests"], first["neighbour_requests"]),
        }
        tables.write_report(stats, path, out)
        return out


def prepare_texts(spark: SparkSession, collection: DataFrame, queries: DataFrame, encoder: Callable[[list[str]], Iterable[Iterable[float]]], path: str, k: int = 100) -> dict[str, DataFrame]:
    """Embeddings, id maps and exact truth of a text collection (id, text) and its queries; tables that are there are kept."""
    step = lambda name, make: tables.stage(spark, f"{path}/{name}", make)
    maps = {n: step(f"{n}_to_index", lambda d=d: tables.id_map(d, "id")) for n, d in (("pid", collection), ("qid", queries))}
    vecs = {n: step(f"{n}_vectors", lambda d=d, m=m: tables.embed(d, encoder).join(m, "id").select(F.col("idx").alias("node_id"), "vec")) for n, d, m in (("pid", collection, maps["pid"]), ("qid", queries, maps["qid"]))}
    truth = step("truth", lambda: exact_topk(vecs["qid"].withColumnRenamed("node_id", "qid"), vecs["pid"], k, "ip", exclude_self=False))
    return {"passages": vecs["pid"], "queries": vecs["qid"], "truth": truth, "pid_to_index": maps["pid"], "qid_to_index": maps["qid"]}
