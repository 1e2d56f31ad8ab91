"""Cluster-routed top-k search in a fixed number of rounds, plain or private.

A query starts in the clusters whose centroids it scores best with. Each round expands the best open nodes of at most two
subgroups, collects their neighbours, and fetches at most two more clusters that hold some, by centroid score and after
pruning; all members of fetched clusters are scored. With pad, as in private searches, the number of rounds and of fetches is the
same for all queries, so that what is fetched gives no more away than that: a query that needs fewer clusters or subgroups
in a round asks for others, drawn by a hash, and ignores them.

State is one table keyed by (qid, node): the nodes that a query has to do with, with flags that only ever go up (visited,
candidate, popped, offered), so that a round is a handful of joins for all queries together and its result a maximum by key.
Plainly scored clusters leave only their best members there; what else is met later is scored when it is. Rounds end in
written tables. Results hold each node once; a cluster that is fetched in a later round than its neighbours were found in
still counts them.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkann.functions.codes import join_parts, prune_factor, unpack_id
from sparkann.functions.vectors import dot
from sparkann.operators import pir
from sparkann.operators.evaluate import moving_average
from sparkann.operators.knn import as_matrix, nearest
from sparkann.operators.layout import Shape, database_cells, encoded_neighbours, renumbered
from sparkann.sources.scratch import written

FLAGS = ("visited", "candidate", "popped", "offered")


@dataclass(frozen=True)
class SearchConfig:
    """Rounds, fetches of a round, and what can be turned off."""

    rounds: int = 5
    clusters_per_round: int = 2
    subgroups_per_round: int = 2
    results_per_cluster: int = 20
    top_candidates: int = 1
    entry_clusters: int = 1
    prune: bool = True
    batch: bool = True
    is_unsigned: bool = False
    pad: bool = False

    @staticmethod
    def from_flags(flags: str, base: SearchConfig | None = None) -> SearchConfig:
        """Ablations by name, comma-separated: no_prune, no_topcand, no_batch, rounds_N, centroid_entry_K, stale_N (without effect)."""
        out = base or SearchConfig()
        for flag in filter(None, (x.strip() for x in flags.split(","))):
            name, _, number = flag.rpartition("_")
            if flag == "no_prune":
                out = replace(out, prune=False)
            elif flag == "no_topcand":
                out = replace(out, top_candidates=0)
            elif flag == "no_batch":
                out = replace(out, batch=False)
            elif name == "rounds" and number.isdigit():
                out = replace(out, rounds=int(number))
            elif name == "centroid_entry" and number.isdigit():
                out = replace(out, entry_clusters=max(1, int(number)))
            elif name == "stale" and number.isdigit():
                warnings.warn("stale_N has no effect", stacklevel=2)
            else:
                raise ValueError(f"no search flag {flag!r}")
        return out


def centroid_scores(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """qid, cluster, cent_dist (negated inner product). The centroids, one a cluster, are what each task holds."""
    rows = sorted((r["cluster"], list(r["centroid"])) for r in centroids.collect())
    names, held = np.array([c for c, _ in rows], np.int32), np.array([v for _, v in rows], np.float64)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                dist = -(as_matrix(batch["qvec"]) @ held.T)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["qid"].to_numpy(zero_copy_only=False), len(names))), pa.array(np.tile(names, batch.num_rows)), pa.array(dist.ravel().astype(np.int64))], ["qid", "cluster", "cent_dist"])

    return queries.select("qid", "qvec").mapInArrow(run, "qid long, cluster int, cent_dist long")


def entries(scores: DataFrame, k: int) -> DataFrame:
    """qid, cluster, cent_dist, rank of the k best clusters, ties to the least."""
    order = Window.partitionBy("qid").orderBy("cent_dist", "cluster")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pruned(pending: DataFrame, best: DataFrame, factor: float) -> DataFrame:
    """Pending clusters (qid, cluster, cent_dist) without those that score less than factor times the best (qid, best), if that
    is a good one at all."""
    limit = F.when(F.col("best") < 0, F.col("best") * factor)
    held = pending.join(best, "qid", "left")
    return held.where(limit.isNull() | (F.col("cent_dist") <= F.ceil(limit))).select(pending.columns)


#: Members of a block, and queries that meet it at once.
MEMBERS, ASKED = 1 << 14, 2048


class Ranked:
    """Plain scores: the best members of wanted clusters by matrix products of blocks, others by pairs."""

    def __init__(self, queries: DataFrame, members: DataFrame):
        """queries: qid, qvec. members: new_id, cluster, local_idx, sg_col, qvec."""
        self.queries, self.members = queries, members

        def pack(table: pa.Table) -> pa.Table:
            vecs = as_matrix(table["qvec"].combine_chunks())
            return pa.table({"cluster": table["cluster"][:1], "part": table["part"][:1], "dim": pa.array([vecs.shape[1]], pa.int32()), **{x: [table[x].to_numpy().astype("<i8").tobytes()] for x in ("new_id", "sg_col")}, "vecs": [vecs.astype("<f4").tobytes()]})

        held = members.where("qvec is not null").select("cluster", F.floor(F.col("local_idx") / MEMBERS).cast("int").alias("part"), "new_id", "sg_col", "qvec")
        self.blocks = written(held.groupBy("cluster", "part").applyInArrow(pack, "cluster int, part int, dim int, new_id binary, sg_col binary, vecs binary"), "member-blocks")
        self.buckets = max(1, -(-queries.count() // ASKED))

    def best(self, pairs: DataFrame, round_: int) -> DataFrame:
        """At least the best `wanted` members of each (qid, cluster, wanted)."""

        def pack(table: pa.Table) -> pa.Table:
            vecs = as_matrix(table["qvec"].combine_chunks())
            return pa.table({"cluster": table["cluster"][:1], "qid": [table["qid"].to_numpy().astype("<i8").tobytes()], "wanted": pa.array([max(table["wanted"].to_pylist())], pa.int32()), "qvecs": [vecs.astype("<f4").tobytes()]})

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    ids, sg_col = (np.frombuffer(r[x], "<i8") for x in ("new_id", "sg_col"))
                    qids, (queries, base) = np.frombuffer(r["qid"], "<i8"), (np.frombuffer(r[x], "<f4").reshape(-1, r["dim"]).astype(np.float64) for x in ("qvecs", "vecs"))
                    q, i, dist = nearest(qids, queries, ids, base, r["wanted"], "ip", False)
                    order = np.argsort(ids)
                    at = order[np.searchsorted(ids, i, sorter=order)]
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(np.full(len(q), r["cluster"], np.int32)), pa.array(sg_col[at].astype(np.int32)), pa.array(np.rint(dist).astype(np.int64))], ["qid", "new_id", "cluster", "sg_col", "dist"])

        asked = pairs.join(self.queries.select("qid", "qvec"), "qid").withColumn("bucket", F.pmod(F.xxhash64("qid"), F.lit(self.buckets)))
        asked = asked.groupBy("cluster", "bucket").applyInArrow(pack, "cluster int, qid binary, wanted int, qvecs binary")
        met = asked.join(self.blocks.select("cluster", "part"), "cluster").join(self.blocks, ["cluster", "part"])
        return met.select("cluster", "qid", "wanted", "qvecs", "dim", "new_id", "sg_col", "vecs").mapInArrow(run, "qid long, new_id long, cluster int, sg_col int, dist long")

    def keep(self, fresh: DataFrame) -> None:
        pass

    def some(self, pairs: DataFrame) -> DataFrame:
        """Scores of pairs (qid, new_id)."""
        held = pairs.select("qid", "new_id").join(self.members.select("new_id", "cluster", "sg_col", "qvec"), "new_id").join(self.queries.select("qid", F.col("qvec").alias("q")), "qid")
        return held.select("qid", "new_id", "cluster", "sg_col", (-dot("q", "qvec", "long")).alias("dist"))


class Whole:
    """Scores of a scorer that answers for whole clusters, as the private one must; all of them are kept."""

    def __init__(self, score: Callable[[DataFrame, int], DataFrame]):
        self.score, self.held = score, None

    def best(self, pairs: DataFrame, round_: int) -> DataFrame:
        return self.score(pairs.select("qid", "cluster"), round_)

    def keep(self, fresh: DataFrame) -> None:
        self.held = fresh if self.held is None else self.held.unionByName(fresh)

    def some(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("qid", "new_id").join(self.held, ["qid", "new_id"]).select("qid", "new_id", "cluster", "sg_col", "dist")


def private_scorer(queries: DataFrame, members: DataFrame, scheme: pir.EmbeddingScheme, seed: int | None = None, block: int = 64) -> Callable[[DataFrame, int], DataFrame]:
    """The same through the embedding scheme, with its noise; a block of queries is answered in one scan."""
    rows = members.select("cluster", "local_idx", "qvec")
    hinted = written(pir.hints(rows, scheme), "hints")
    spark = members.sparkSession

    def score(pairs: DataFrame, round_: int) -> DataFrame:
        wanted = [(r["qid"], r["cluster"], np.array(r["qvec"], np.int64)) for r in pairs.select("qid", "cluster").join(queries.select("qid", "qvec"), "qid").orderBy("qid", "cluster").collect()]
        out = None
        for at in range(0, len(wanted), block):
            part = wanted[at : at + block]
            got = pir.private_products(rows, scheme, [(i, c, v) for i, (_, c, v) in enumerate(part)], hinted, None if seed is None else seed + 7919 * (round_ + 1) + at)
            names = spark.createDataFrame([(i, q, c) for i, (q, c, _) in enumerate(part)], "ct long, qid long, cluster int")
            got = written(got.join(F.broadcast(names), "ct").select("qid", "cluster", "local_idx", (-F.col("value")).alias("dist")), "products")
            out = got if out is None else out.unionByName(got)
        if out is None:
            out = spark.createDataFrame([], "qid long, cluster int, local_idx int, dist long")
        return members.select("new_id", "cluster", "local_idx", "sg_col").join(out, ["cluster", "local_idx"]).select("qid", "new_id", "cluster", "sg_col", "dist")

    return score


def private_fetcher(laid: DataFrame, edges: DataFrame, sizes: Shape, lwe: int = 1024, seed: int | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """The neighbours of wanted subgroups (qid, sg_col) as qid, new_id, nbr_id, nbr_cluster, retrieved through the neighbour scheme."""
    spark = laid.sparkSession
    scheme = pir.NeighbourScheme(sizes, n=lwe)
    db = pir.database(database_cells(encoded_neighbours(edges, laid, sizes), laid, sizes), scheme)
    hinted = written(pir.neighbour_hints(db, scheme), "neighbour-hints")
    at = laid.select("sg_col", "idx_in_sg", "new_id")
    ids = laid.select("cluster", "local_idx", F.col("new_id").alias("nbr_id"))

    def fetch(pairs: DataFrame, round_: int) -> DataFrame:
        wanted = [(r["qid"], r["sg_col"]) for r in pairs.select("qid", "sg_col").orderBy("qid", "sg_col").collect()]  # a few of each query
        if not wanted:
            return spark.createDataFrame([], "qid long, new_id long, nbr_id long, nbr_cluster int")
        got = pir.private_columns(db, scheme, {i: c for i, (_, c) in enumerate(wanted)}, hinted, None if seed is None else seed + 104729 * round_)
        cluster, local = unpack_id(F.col("code"), sizes.local_bits)
        held = pir.column_parts(got, sizes).withColumn("code", join_parts(F.col("parts"))).where("code is not null")
        names = spark.createDataFrame([(i, q, c) for i, (q, c) in enumerate(wanted)], "ct long, qid long, sg_col int")
        held = held.join(names, "ct").select("qid", "sg_col", "idx_in_sg", cluster.cast("int").alias("cluster"), local.cast("int").alias("local_idx"))
        return written(held.join(at, ["sg_col", "idx_in_sg"]).join(ids, ["cluster", "local_idx"]).select("qid", "new_id", "nbr_id", F.col("cluster").alias("nbr_cluster")), "links")

    return fetch


def padded_clusters(chosen: DataFrame, scores: DataFrame, most: int, round_: int) -> DataFrame:
    """qid, cluster: chosen ones and as many others as are missing from most, drawn by a hash."""
    free = scores.select("qid", "cluster").join(chosen.select("qid", "cluster"), ["qid", "cluster"], "left_anti")
    free = free.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.xxhash64("qid", "cluster", F.lit(round_)), "cluster")))
    have = chosen.groupBy("qid").agg(F.count("*").alias("have"))
    pads = free.join(have, "qid", "left").where(F.col("nth") <= most - F.coalesce("have", F.lit(0)))
    return chosen.select("qid", "cluster").unionByName(pads.select("qid", "cluster"))


def padded_subgroups(wanted: DataFrame, queries: DataFrame, columns: int, most: int, round_: int) -> DataFrame:
    """qid, sg_col: wanted ones and as many others as are missing from most, drawn by a hash."""
    have = wanted.groupBy("qid").agg(F.count("*").alias("have"))
    missing = queries.select("qid").join(have, "qid", "left").withColumn("missing", most - F.coalesce("have", F.lit(0))).where("missing > 0")
    pads = missing.select("qid", F.explode(F.sequence(F.lit(1).cast("long"), F.col("missing").cast("long"))).alias("nth"))
    return wanted.select("qid", "sg_col").unionByName(pads.select("qid", F.pmod(F.xxhash64("qid", "nth", F.lit(round_)), F.lit(columns)).cast("int").alias("sg_col")))


def flagged(rows: DataFrame, **on: bool | Column) -> DataFrame:
    return rows.select("qid", "new_id", "cluster", "sg_col", "dist", *((on[f] if isinstance(on.get(f), Column) else F.lit(on.get(f, False))).alias(f) for f in FLAGS))


def merged(*tables: DataFrame) -> DataFrame:
    held = tables[0]
    for t in tables[1:]:
        held = held.unionByName(t)
    return held.groupBy("qid", "new_id").agg(*(F.min(c).alias(c) for c in ("cluster", "sg_col", "dist")), *(F.max(f).alias(f) for f in FLAGS))


def results(state: DataFrame, ef: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "new_id")
    return state.where("offered").withColumn("r", F.row_number().over(order)).where(F.col("r") <= ef)


def members_offered(fresh: DataFrame, config: SearchConfig, first: bool) -> DataFrame:
    """Of newly fetched clusters, the best members are offered, and the very best become candidates."""
    order = Window.partitionBy("qid", "cluster").orderBy("dist", "new_id")
    held = fresh.withColumn("r", F.row_number().over(order))
    seeds = max(config.top_candidates, 1) if first else config.top_candidates
    seed = F.col("r") <= seeds
    return flagged(held.where(seed | (F.col("r") <= config.results_per_cluster)), offered=F.col("r") <= config.results_per_cluster, candidate=seed, visited=seed)


def batch_of(state: DataFrame, cached: DataFrame, ef: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Open candidates to expand, in order of distance up to the first that would need one subgroup too many, and the subgroups
    to fetch. Candidates beyond a full result list stay open."""
    bound = results(state, ef).groupBy("qid").agg(F.when(F.count("*") >= ef, F.max("dist")).alias("bound"))
    open_ = state.where("candidate and not popped").join(bound, "qid", "left").where("bound is null or dist <= bound")
    order = Window.partitionBy("qid").orderBy("dist", "new_id")
    ranked = written(open_.withColumn("r", F.row_number().over(order)).drop("bound"), "open")
    needed = ranked.join(cached, ["qid", "sg_col"], "left_anti").groupBy("qid", "sg_col").agg(F.min("r").alias("first"))
    needed = needed.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("first", "sg_col")))
    needed = written(needed.where(F.col("nth") <= most + 1), "needed")
    stop = needed.where(F.col("nth") == most + 1).select("qid", F.col("first").alias("stop"))
    taken = ranked.join(stop, "qid", "left").where("stop is null or r < stop").drop("r", "stop")
    return taken, needed.where(F.col("nth") <= most).select("qid", "sg_col")


def routed_search(queries: DataFrame, laid: DataFrame, qvectors: DataFrame, edges: DataFrame, centroids: DataFrame, k: int = 10, ef: int = 50, config: SearchConfig | None = None, scorer: Callable[[DataFrame, int], DataFrame] | None = None, fetcher: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """queries: qid, qvec. laid: a layout. qvectors: node_id, qvec. edges: node_id, slot, nbr (level 0). scorer and fetcher: how
    clusters are scored and neighbours found, plainly if not given. Returns results (qid, rank, node_id, dist) and stats (one
    row a query)."""
    config = config or SearchConfig()
    spark = queries.sparkSession
    members = laid.join(qvectors.select("node_id", "qvec"), "node_id").select("node_id", "new_id", "cluster", "local_idx", "sg_col", "qvec")
    scored = Whole(scorer) if scorer else Ranked(queries, members)
    full = members.groupBy("cluster").agg(F.count("*").alias("size"))
    most = max(config.results_per_cluster, config.top_candidates, 1)
    linked = None if fetcher else written(renumbered(edges, laid).select("new_id", "nbr_id", F.col("cluster").alias("nbr_cluster")).distinct(), "linked")
    sizes = laid.agg(F.count("*"), F.count_distinct("cluster"), F.max("sg_col")).first()
    factor = prune_factor(sizes[0] // max(1, sizes[1]), config.is_unsigned)
    scores = written(centroid_scores(queries, centroids), "centroid-scores")
    start = written(entries(scores, config.entry_clusters), "entries")
    best = start.where("rank = 1").select("qid", F.col("cent_dist").alias("best"))
    fetched = start.select("qid", "cluster", F.lit(0).alias("round"))
    fresh = written(scored.best(start.select("qid", "cluster", F.lit(most).alias("wanted")), 0).select("qid", "new_id", "cluster", "sg_col", "dist"), "fetched")
    scored.keep(fresh)
    state = written(merged(members_offered(fresh, config, True)), "state")
    cached = spark.createDataFrame([], "qid long, sg_col int")
    pending = spark.createDataFrame([], "qid long, cluster int, cent_dist long, round int")
    waiting = spark.createDataFrame([], "qid long, new_id long, cluster int")
    skipped = spark.createDataFrame([], "qid long, n long")
    for i in range(1, config.rounds + 1):
        taken, wanted = batch_of(state, cached, ef, config.subgroups_per_round)
        taken = written(taken, "taken")
        cached = written(cached.unionByName(wanted.select("qid", F.col("sg_col").cast("int").alias("sg_col"))), "cached")
        if fetcher:
            asked = padded_subgroups(wanted, queries, (sizes[2] or 0) + 1, config.subgroups_per_round, i) if config.pad else wanted
            fetched_links = fetcher(asked, i)
            linked = fetched_links if linked is None else written(linked.unionByName(fetched_links).distinct(), "linked")
        near = taken.join(linked, ["qid", "new_id"] if fetcher else "new_id").select("qid", F.col("nbr_id").alias("new_id"), F.col("nbr_cluster").alias("cluster")).distinct()
        near = near.join(fetched.select("qid", "cluster", F.lit(True).alias("here")), ["qid", "cluster"], "left").join(state.where("visited").select("qid", "new_id"), ["qid", "new_id"], "left_anti")
        near = written(near.select("qid", "new_id", "cluster", "here"), "near")
        here, away = scored.some(near.where("here")), near.where("here is null").select("qid", "new_id", "cluster")
        waiting = written(waiting.unionByName(away).distinct(), "waiting")
        found = away.select("qid", "cluster").distinct().join(scores, ["qid", "cluster"]).withColumn("round", F.lit(i))
        both = pending.unionByName(found.select(pending.columns)).groupBy("qid", "cluster").agg(F.min("cent_dist").alias("cent_dist"), F.min("round").alias("round"))
        both = written(both, "pending")
        best = written(best.unionByName(both.select("qid", F.col("cent_dist").alias("best"))).groupBy("qid").agg(F.min("best").alias("best")), "best")
        kept = pruned(both, best, factor) if config.prune else both
        skipped = skipped.unionByName(both.join(kept, ["qid", "cluster"], "left_anti").groupBy("qid").agg(F.count("*").alias("n")))
        order = Window.partitionBy("qid").orderBy(*(["cent_dist", "cluster"] if config.prune else ["round", "cluster"]))
        ranked = written(kept.withColumn("nth", F.row_number().over(order)), "ranked")
        chosen = ranked.where(F.col("nth") <= config.clusters_per_round)
        pending = ranked.where(F.col("nth") > config.clusters_per_round).select(pending.columns)
        asked = padded_clusters(chosen, scores, config.clusters_per_round, i) if config.pad else chosen.select("qid", "cluster")
        met = waiting.groupBy("qid", "cluster").agg(F.count("*").alias("met"))  # these don't count among the best
        fresh = scored.best(asked.join(met, ["qid", "cluster"], "left").select("qid", "cluster", (most + F.coalesce("met", F.lit(0))).cast("int").alias("wanted")), i)
        fresh = fresh.join(chosen.select("qid", "cluster"), ["qid", "cluster"], "left_semi") if config.pad else fresh
        fresh = written(fresh.select("qid", "new_id", "cluster", "sg_col", "dist"), "fetched")
        scored.keep(fresh)
        reached = scored.some(waiting.join(chosen.select("qid", "cluster"), ["qid", "cluster"], "left_semi"))
        rest = fresh.join(waiting.select("qid", "new_id"), ["qid", "new_id"], "left_anti")
        waiting = waiting.join(chosen.select("qid", "cluster"), ["qid", "cluster"], "left_anti").select("qid", "new_id", "cluster")
        fetched = written(fetched.unionByName(chosen.select("qid", "cluster", F.lit(i).alias("round"))), "fetched-clusters")
        on = {"visited": True, "candidate": True, "offered": True}
        state = written(merged(state, flagged(taken, popped=True, visited=True, candidate=True, offered=True), flagged(here, **on), flagged(reached, **on), members_offered(rest, config, False)), "state")
    order = Window.partitionBy("qid").orderBy("dist", "new_id")
    ids = laid.select("node_id", "new_id")
    out = results(state, ef).where(F.col("r") <= k).join(ids, "new_id").select("qid", F.row_number().over(order).alias("rank"), "node_id", "dist")
    stats = queries.select("qid").join(fetched.groupBy("qid").agg(F.count("*").alias("clusters_fetched")), "qid", "left")
    stats = stats.join(cached.groupBy("qid").agg(F.count("*").alias("subgroups_fetched")), "qid", "left").join(skipped.groupBy("qid").agg(F.sum("n").alias("clusters_skipped")), "qid", "left")
    stats = stats.join(fetched.join(F.broadcast(full), "cluster").groupBy("qid").agg(F.sum("size").alias("nodes_scored")), "qid", "left").join(state.groupBy("qid").agg(F.count_if("visited").alias("nodes_visited")), "qid", "left")
    per_round = config.clusters_per_round + config.subgroups_per_round
    stats = stats.na.fill(0).withColumns({"embedding_requests": F.lit(config.entry_clusters + config.rounds * config.clusters_per_round), "neighbour_requests": F.lit(config.rounds * config.subgroups_per_round), "round_trips": F.lit(1 + config.rounds * (2 if config.batch else per_round))})
    padded = {f"{x}_padded": F.col(f"{r}_requests") - F.col(f"{x}_fetched") if config.pad else F.lit(0).cast("long") for x, r in (("clusters", "embedding"), ("subgroups", "neighbour"))}
    return out, stats.withColumns(padded)


def pool_size(history: list[float], ef: int, clusters: int) -> int:
    """Secrets to prepare for the next query: from the usage so far, with a fifth to spare."""
    return int(min(ef + 5, 0.3 * clusters)) if not history else int(1.2 * moving_average(history)) + 1


def secret_pool(scheme: pir.EmbeddingScheme, n: int, seed: int | None = None) -> list[np.ndarray]:
    return [pir.ring.secret(scheme.n, None if seed is None else seed + i) for i in range(n)]
