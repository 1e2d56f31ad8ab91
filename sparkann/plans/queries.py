"""Queries over the driver's tables, each with the SQL that says the same.

Embeddings are the vectors, signed and of unit norm; label is the deterministic clustering. Searches take every row whose
vec_id is divisible by 100 as a query against all other rows. Quantized vectors are compared in exact integers; doubles are
rounded where sums may be ordered in several ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkann.functions import codes
from sparkann.functions import vectors as vf
from sparkann.functions.quantizer import Quantizer, data_range, four_bit
from sparkann.operators import cluster, evaluate, graph, knn, layout, pir, ring, search
from sparkann.sources.scratch import written
from sparkann.sources.tables import id_map

K, M, SUBGROUP, EVERY = 10, 8, 16, 100


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"))


def quantizer(spark: SparkSession, sf_dir: str, is_unsigned: bool = False) -> Quantizer:
    return Quantizer(is_unsigned=is_unsigned).fit(embeddings(spark, sf_dir))


def qvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantizer(spark, sf_dir)
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("node_id"), "label", q("embedding").alias("vec"))


def query_rows(q: DataFrame) -> DataFrame:
    return q.where(F.col("node_id") % EVERY == 0).select(F.col("node_id").alias("qid"), "vec")


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("node_id"), F.col("label").alias("cluster"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact graph of the M nearest by integer inner product."""
    return written(knn.knn_graph(qvectors(spark, sf_dir), M, "ip").select("node_id", "slot", "nbr", F.col("dist").cast("long").alias("dist")), "edges")


# --- SQL fragments --------------------------------------------------------------------------------------------------

NORMALIZED = """n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) + 1e-10)) AS v FROM embeddings)"""
SCALE = """s AS (SELECT 127 / (max(greatest(abs(list_max(v)), abs(list_min(v)))) + 1e-6) AS scale FROM n)"""
QUANTIZED = f"""{NORMALIZED}, {SCALE},
q AS (SELECT vec_id, label, list_transform(v, lambda x: greatest(-128, least(127, round(x * scale)))::INTEGER) AS qv FROM n, s)"""
PAIRS = f"""{QUANTIZED},
p AS (SELECT a.vec_id AS qid, b.vec_id AS node_id, list_inner_product(a.qv::DOUBLE[], b.qv::DOUBLE[])::BIGINT AS ip FROM q a JOIN q b ON a.vec_id <> b.vec_id)"""
EDGES = f"""{PAIRS},
e AS (SELECT qid AS node_id, node_id AS nbr, row_number() OVER (PARTITION BY qid ORDER BY ip DESC, node_id) - 1 AS slot, -ip AS dist FROM p QUALIFY slot < {M})"""
PARTED = "c AS (SELECT vec_id AS node_id, label AS cluster FROM embeddings)"
SYMMETRIC = "u AS (SELECT DISTINCT least(node_id, nbr) AS u, greatest(node_id, nbr) AS v FROM e WHERE node_id <> nbr)"
LAYOUT = f"""{PARTED},
z AS (SELECT cluster, count(*) AS n FROM c GROUP BY cluster),
o AS (SELECT cluster, coalesce(sum(n) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo, sum(n) OVER (ORDER BY cluster)::BIGINT AS hi FROM z),
w AS (SELECT ceil(max(n) / {SUBGROUP}.0)::INTEGER AS per_cluster FROM z),
l AS (SELECT node_id, lo + local_idx AS new_id, cluster, local_idx, (local_idx // {SUBGROUP})::INTEGER AS subgroup, local_idx % {SUBGROUP} AS idx_in_sg, cluster * per_cluster + local_idx // {SUBGROUP} AS sg_col
      FROM (SELECT node_id, cluster, (row_number() OVER (PARTITION BY cluster ORDER BY node_id) - 1)::INTEGER AS local_idx FROM c) JOIN o USING (cluster), w)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- scalar functions and quantization --------------------------------------------------------------------------------


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) + 1e-10), 6) AS norm FROM embeddings""")
def vector_norms(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.round(vf.norm("embedding"), 6).alias("norm"))


@query("""SELECT min(list_min(embedding))::DOUBLE AS low, max(list_max(embedding))::DOUBLE AS high, min(list_min(embedding)) < 0 AS is_signed FROM embeddings""")
def data_range_stats(spark, sf_dir):
    r = data_range(embeddings(spark, sf_dir))
    return spark.createDataFrame([(r["low"], r["high"], r["is_signed"])], "low double, high double, is_signed boolean")


@query(f"WITH {NORMALIZED}, {SCALE} SELECT round(scale, 6) AS scale, -128 AS low, 127 AS high FROM s")
def quantizer_params(spark, sf_dir):
    q = quantizer(spark, sf_dir)
    return spark.createDataFrame([(round(q.scale, 6), q.low, q.high)], "scale double, low int, high int")


@query(f"WITH {QUANTIZED} SELECT vec_id, unnest(range(len(qv)))::INTEGER AS i, unnest(qv) AS x FROM q")
def quantize_signed(spark, sf_dir):
    return qvectors(spark, sf_dir).select(F.col("node_id").alias("vec_id"), F.posexplode("vec").alias("i", "x")).withColumn("x", F.col("x").cast("int"))


@query("""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)) + 1e-10)) AS v FROM a),
s AS (SELECT 255 / (max(list_max(v)) + 1e-6) AS scale FROM n)
SELECT vec_id, unnest(range(len(v)))::INTEGER AS i, unnest(list_transform(v, lambda x: greatest(0, least(255, round(x * scale)))::INTEGER)) AS x FROM n, s""")
def quantize_unsigned(spark, sf_dir):
    held = embeddings(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("embedding"))
    q = Quantizer(is_unsigned=True).fit(held)
    return held.select("vec_id", F.posexplode(q("embedding")).alias("i", "x")).withColumn("x", F.col("x").cast("int"))


@query("""SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS i, unnest(list_transform(embedding, lambda x: greatest(0, least(15, floor((x::DOUBLE + 1) * 7.5)))::INTEGER)) AS x FROM embeddings""")
def quantize_four_bit(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(four_bit("embedding")).alias("i", "x")).withColumn("x", F.col("x").cast("int"))


@query("""SELECT vec_id, (vec_id * 7919 + 13) % 1000003 AS value, unnest(range(4))::INTEGER AS digit, unnest(list_transform(range(4), lambda i: ((vec_id * 7919 + 13) % 1000003 // (991 ** i)::BIGINT) % 991))::BIGINT AS x FROM embeddings""")
def base_p_digits(spark, sf_dir):
    value = (F.col("vec_id") * 7919 + 13) % 1000003
    return embeddings(spark, sf_dir).select("vec_id", value.alias("value"), F.posexplode(codes.base_digits(value, 991, 4)).alias("digit", "x"))


@query("""WITH x AS (SELECT vec_id, (vec_id * 2654435761 + 12345) % 4294967296 AS x FROM embeddings)
SELECT vec_id, x, (((x + (4294967296 // 991) // 2) // (4294967296 // 991)) % 991)::BIGINT AS plain FROM x""")
def delta_round(spark, sf_dir):
    x = (F.col("vec_id") * 2654435761 + 12345) % codes.RING
    return embeddings(spark, sf_dir).select("vec_id", x.alias("x")).withColumn("plain", codes.rounded(F.col("x"), 991))


@query("""WITH u AS (SELECT vec_id AS node_id, ((vec_id * 40503 + 7) % 65536 + 1) / 65536.0 AS u FROM embeddings)
SELECT node_id, least(15, floor(-ln(u) / ln(16.0)))::INTEGER AS level FROM u""")
def hnsw_levels(spark, sf_dir):
    u = ((F.col("vec_id") * 40503 + 7) % 65536 + 1) / 65536.0
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("node_id"), codes.hnsw_level(u, 16).alias("level"))


# --- nearest neighbours -----------------------------------------------------------------------------------------------

RANKED = "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, node_id)::INTEGER AS rank, node_id, dist FROM d QUALIFY rank <= 10"


@query(f"WITH {PAIRS}, d AS (SELECT qid, node_id, -ip AS dist FROM p WHERE qid % {EVERY} = 0) {RANKED}")
def ip_topk(spark, sf_dir):
    q = qvectors(spark, sf_dir)
    return knn.exact_topk(query_rows(q), q, K, "ip").withColumn("dist", F.col("dist").cast("long"))


@query(f"""WITH {QUANTIZED}, d AS (SELECT a.vec_id AS qid, b.vec_id AS node_id, list_sum(list_transform(list_zip(a.qv, b.qv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0) {RANKED}""")
def l2_topk(spark, sf_dir):
    q = qvectors(spark, sf_dir)
    return knn.exact_topk(query_rows(q), q, K, "l2").withColumn("dist", F.col("dist").cast("long"))


@query(f"""WITH {PAIRS} SELECT qid, count(*) AS pairs, min(-ip) AS least, max(-ip) AS greatest, sum(-ip)::BIGINT AS total FROM p WHERE qid % {EVERY} = 0 GROUP BY qid""")
def cross_distance_stats(spark, sf_dir):
    """Distances by columns: query blocks joined to all rows on a block key."""
    q = qvectors(spark, sf_dir)
    asked = query_rows(q).select("qid", F.col("vec").alias("qvec"))
    dist = vf.distance("qvec", "vec", "ip", "long")
    pairs = q.join(F.broadcast(asked), F.col("qid") != F.col("node_id")).select("qid", dist.alias("dist"))
    return pairs.groupBy("qid").agg(F.count("*").alias("pairs"), F.min("dist").alias("least"), F.max("dist").alias("greatest"), F.sum("dist").alias("total"))


# --- clusters ---------------------------------------------------------------------------------------------------------


@query(f"WITH {PARTED}, z AS (SELECT cluster, count(*) AS n FROM c GROUP BY cluster) SELECT count(*) AS clusters, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS average, round((max(n) - avg(n)) / avg(n), 6) AS imbalance FROM z")
def cluster_stats(spark, sf_dir):
    r = cluster.size_stats(assignment(spark, sf_dir))
    return r.withColumns({c: F.round(c, 6) for c in ("average", "imbalance")})


CENTROIDS = f"""{QUANTIZED}, x AS (SELECT label AS cluster, unnest(range(len(qv)))::INTEGER AS i, unnest(qv) AS x FROM q),
m AS (SELECT cluster, i, greatest(-128, least(127, round(avg(x))))::INTEGER AS x FROM x GROUP BY cluster, i)"""


@query(f"WITH {CENTROIDS} SELECT cluster, i, x FROM m")
def cluster_centroids(spark, sf_dir):
    held = cluster.centroids(qvectors(spark, sf_dir).withColumnRenamed("label", "cluster"))
    return held.select("cluster", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.col("x").cast("int"))


CENTROID_SCORES = f"""{CENTROIDS}, cv AS (SELECT cluster, list(x ORDER BY i) AS centroid FROM m GROUP BY cluster),
cs AS (SELECT q.vec_id AS qid, cluster, -list_inner_product(qv::DOUBLE[], centroid::DOUBLE[])::BIGINT AS cent_dist FROM q, cv WHERE q.vec_id % {EVERY} = 0)"""


def scores_of(spark, sf_dir) -> DataFrame:
    q = qvectors(spark, sf_dir)
    return search.centroid_scores(query_rows(q).withColumnRenamed("vec", "qvec"), cluster.centroids(q.withColumnRenamed("label", "cluster")))


@query(f"WITH {CENTROID_SCORES} SELECT qid, cluster, cent_dist, row_number() OVER (PARTITION BY qid ORDER BY cent_dist, cluster)::INTEGER AS rank FROM cs QUALIFY rank <= 3")
def centroid_entry(spark, sf_dir):
    return search.entries(scores_of(spark, sf_dir), 3)


@query(f"""WITH {CENTROID_SCORES}, b AS (SELECT qid, min(cent_dist) AS best FROM cs GROUP BY qid)
SELECT qid, cluster, cent_dist FROM cs JOIN b USING (qid) WHERE best >= 0 OR cent_dist <= ceil(best * 0.8)""")
def centroid_prune(spark, sf_dir):
    held = scores_of(spark, sf_dir)
    return search.pruned(held, held.groupBy("qid").agg(F.min("cent_dist").alias("best")), codes.prune_factor(0, False))


SEEDS = f"""{QUANTIZED}, k AS (SELECT vec_id::INTEGER AS cluster, qv AS c FROM q ORDER BY vec_id LIMIT 5),
d AS (SELECT vec_id AS node_id, qv, cluster, list_sum(list_transform(list_zip(qv, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::DOUBLE AS dist FROM q, k),
a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY dist, cluster) = 1)"""


def seeds_of(q: DataFrame, k: int = 5) -> list[tuple[int, list[float]]]:
    rows = q.orderBy("node_id").limit(k).select("node_id", "vec").collect()
    return [(r["node_id"], [float(x) for x in r["vec"]]) for r in rows]


@query(f"WITH {SEEDS} SELECT node_id, cluster, dist FROM a")
def kmeans_assign(spark, sf_dir):
    q = qvectors(spark, sf_dir)
    return cluster.nearest_centroid(q, seeds_of(q)).select("node_id", "cluster", "dist")


@query(f"""WITH {SEEDS}, x AS (SELECT cluster, unnest(range(len(qv)))::INTEGER AS i, unnest(qv) AS x FROM a) SELECT cluster, i, round(avg(x), 6) AS x FROM x GROUP BY cluster, i""")
def kmeans_step(spark, sf_dir):
    q = qvectors(spark, sf_dir)
    return cluster.lloyd_step(q, seeds_of(q)).select("cluster", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@query()
def kmeans_clusters(spark, sf_dir):
    """Rows only: iterations from drawn seeds."""
    return cluster.kmeans(vectors(spark, sf_dir), 10)


# --- graphs -----------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT node_id, slot::INTEGER AS slot, nbr, dist FROM e")
def knn_graph(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH {EDGES}, {SYMMETRIC} SELECT u AS node_id, v AS nbr FROM u UNION ALL SELECT v, u FROM u")
def symmetric_edges(spark, sf_dir):
    return graph.symmetric(edges(spark, sf_dir))


@query(f"""WITH {EDGES}, {PARTED} SELECT count(*) AS edges, count(*) FILTER (a.cluster <> b.cluster) AS cut, round(avg((a.cluster <> b.cluster)::INTEGER), 6) AS cut_ratio
FROM e JOIN c a ON a.node_id = e.node_id JOIN c b ON b.node_id = e.nbr""")
def edge_cut(spark, sf_dir):
    return cluster.edge_cut(edges(spark, sf_dir), assignment(spark, sf_dir)).withColumn("cut_ratio", F.round("cut_ratio", 6))


@query(f"""WITH {EDGES}, {PARTED} SELECT a.cluster, count(DISTINCT b.cluster) FILTER (a.cluster <> b.cluster) AS neighbour_clusters
FROM e JOIN c a ON a.node_id = e.node_id JOIN c b ON b.node_id = e.nbr GROUP BY a.cluster""")
def neighbor_clusters(spark, sf_dir):
    return cluster.neighbour_clusters(edges(spark, sf_dir), assignment(spark, sf_dir))


@query(f"""WITH {EDGES}, {SYMMETRIC}, {PARTED} SELECT least(a.cluster, b.cluster) AS u, greatest(a.cluster, b.cluster) AS v, count(*) AS w
FROM u JOIN c a ON a.node_id = u.u JOIN c b ON b.node_id = u.v WHERE a.cluster <> b.cluster GROUP BY ALL""")
def coarse_edges(spark, sf_dir):
    into = assignment(spark, sf_dir).select(F.col("node_id").alias("id"), F.col("cluster").alias("into"))
    return cluster.coarse_edges(cluster.undirected(edges(spark, sf_dir)), into)


@query(f"""WITH {EDGES}, {SYMMETRIC}, {PARTED}, b AS (SELECT u, v FROM u UNION ALL SELECT v, u FROM u),
sc AS (SELECT b.u AS id, c.cluster AS to_part, count(*) AS pull FROM b JOIN c ON c.node_id = b.v GROUP BY ALL)
SELECT id, own.cluster AS part, to_part, pull, coalesce(max(CASE WHEN to_part = own.cluster THEN pull END) OVER (PARTITION BY id), 0) AS own FROM sc JOIN c own ON own.node_id = sc.id""")
def label_scores(spark, sf_dir):
    parts = assignment(spark, sf_dir).select(F.col("node_id").alias("id"), F.col("cluster").alias("part"))
    return cluster.gains(cluster.undirected(edges(spark, sf_dir)), parts).withColumnRenamed("to", "to_part")


@query()
def heavy_edge_matching(spark, sf_dir):
    """Rows only: ties fall by a hash that SQL lacks; a test checks that matches are mutual."""
    nodes = vectors(spark, sf_dir).select(F.col("node_id").alias("id"), F.lit(1).cast("long").alias("w"))
    return cluster.heavy_edge_matching(cluster.undirected(edges(spark, sf_dir)), nodes)


@query()
def graph_partition(spark, sf_dir):
    """Rows only: balanced parts by coarsening and refinement."""
    return cluster.partition_graph(edges(spark, sf_dir), vectors(spark, sf_dir), 10)


@query("SELECT count(*) AS nodes, 10::BIGINT AS parts, true AS balanced FROM embeddings")
def partition_checks(spark, sf_dir):
    """Every node has one of ten parts, none of which is over its limit by more than a node."""
    sizes = cluster.cluster_sizes(graph_partition(spark, sf_dir))
    total = F.sum("size")
    return sizes.agg(total.alias("nodes"), F.count("*").alias("parts"), (F.max("size") <= (1 + cluster.IMBALANCE) * total / 10 + 1).alias("balanced"))


@query("SELECT count(*) AS nodes, true AS pairs_at_most, true AS mutual FROM embeddings")
def matching_checks(spark, sf_dir):
    """Groups of a matching hold two nodes at most, named by the smaller one."""
    groups = heavy_edge_matching(spark, sf_dir).groupBy("into").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    return groups.agg(F.sum("n").alias("nodes"), (F.max("n") <= 2).alias("pairs_at_most"), F.bool_and(F.col("least") == F.col("into")).alias("mutual"))


@query("SELECT count(*) AS nodes, true AS within_degree, true AS no_loops, true AS ends_exist FROM embeddings")
def graph_checks(spark, sf_dir):
    """Of a built graph: every node has level 0 edges, at most 2 M there and M above, none to itself, all to nodes."""
    found = graph_build(spark, sf_dir)
    degrees = found.groupBy("node_id", "level").agg(F.count("*").alias("n"), F.max((F.col("node_id") == F.col("nbr")).cast("int")).alias("loop"))
    most = F.when(F.col("level") == 0, 2 * M).otherwise(M)
    out = degrees.agg(F.count_if(F.col("level") == 0).alias("nodes"), F.bool_and(F.col("n") <= most).alias("within_degree"), (F.max("loop") == 0).alias("no_loops"))
    lost = found.join(vectors(spark, sf_dir).select(F.col("node_id").alias("nbr")), "nbr", "left_anti").agg((F.count("*") == 0).alias("ends_exist"))
    return out.join(lost, F.lit(True))


def built(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return graph.build_graph(vectors(spark, sf_dir), m=M, ef_construction=64)


@query()
def graph_build(spark, sf_dir):
    """Rows only: pruned edges of all levels."""
    return built(spark, sf_dir)[1].select("node_id", "level", "slot", "nbr")


@query()
def graph_beam_search(spark, sf_dir):
    """Rows only: approximate; a test checks recall. The beam holds 64 nodes, and more where a sample needs more."""
    v = vectors(spark, sf_dir)
    nodes, found = built(spark, sf_dir)
    return graph.graph_search(query_rows(v), v, nodes, found, K, graph.wide_enough(v, nodes, found, K, 64), exclude_self=True).withColumn("dist", F.round("dist", 6))


# --- layout -----------------------------------------------------------------------------------------------------------


@query(f"WITH {LAYOUT} SELECT cluster, lo, hi FROM o")
def cluster_offsets(spark, sf_dir):
    return layout.offsets(assignment(spark, sf_dir))


@query(f"WITH {LAYOUT} SELECT node_id, new_id, cluster, local_idx, subgroup, idx_in_sg, sg_col::BIGINT AS sg_col FROM l")
def renumber(spark, sf_dir):
    return layout.layout(assignment(spark, sf_dir), SUBGROUP).withColumn("sg_col", F.col("sg_col").cast("long"))


@query(f"WITH {LAYOUT} SELECT cluster, subgroup, count(*) AS size, min(new_id) AS first_id FROM l GROUP BY cluster, subgroup")
def subgroups(spark, sf_dir):
    return layout.layout(assignment(spark, sf_dir), SUBGROUP).groupBy("cluster", "subgroup").agg(F.count("*").alias("size"), F.min("new_id").alias("first_id"))


@query()
def renumber_bfs(spark, sf_dir):
    """Rows only: breadth-first order within clusters; a test checks it against a queue."""
    a, e = assignment(spark, sf_dir), edges(spark, sf_dir)
    return layout.layout(a, SUBGROUP, graph.cluster_bfs(a, e))


@query("SELECT label AS cluster, count(*) AS nodes, true AS dense FROM embeddings GROUP BY label")
def bfs_checks(spark, sf_dir):
    """New ids in breadth-first order are dense within each cluster, and local indices count them."""
    held = renumber_bfs(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("nodes"), F.count_distinct("new_id").alias("ids"), (F.max("new_id") - F.min("new_id") + 1).alias("width"), F.max("local_idx").alias("last"))
    return held.select("cluster", "nodes", ((F.col("ids") == F.col("nodes")) & (F.col("width") == F.col("nodes")) & (F.col("last") == F.col("nodes") - 1)).alias("dense"))


@query(f"""WITH {EDGES}, {LAYOUT}, g AS (SELECT a.new_id, b.cluster, b.subgroup, list(b.idx_in_sg ORDER BY e.slot) AS locals FROM e JOIN l a ON a.node_id = e.node_id JOIN l b ON b.node_id = e.nbr GROUP BY ALL)
SELECT new_id, cluster, subgroup, array_to_string(locals, ',') AS locals FROM g""")
def neighbor_groups(spark, sf_dir):
    held = layout.neighbour_groups(edges(spark, sf_dir), layout.layout(assignment(spark, sf_dir), SUBGROUP))
    g = held.select("new_id", F.explode("groups").alias("g"))
    return g.select("new_id", "g.cluster", "g.subgroup", F.array_join(F.transform("g.local_indices", lambda x: x.cast("string")), ",").alias("locals"))


def laid_out(spark, sf_dir) -> tuple[DataFrame, DataFrame, layout.Shape]:
    laid = written(layout.layout(assignment(spark, sf_dir), SUBGROUP), "layout")
    return laid, edges(spark, sf_dir), layout.shape(laid, SUBGROUP, M)


CODES = f"""{EDGES}, {LAYOUT}, b AS (SELECT ceil(log2(max(n) + 1))::INTEGER AS bits FROM z),
k AS (SELECT a.new_id, e.slot::INTEGER AS slot, (b.cluster::BIGINT << (SELECT bits FROM b)) | b.local_idx AS code, b.new_id AS nbr_id, b.cluster AS cluster, b.local_idx AS local_idx FROM e JOIN l a ON a.node_id = e.node_id JOIN l b ON b.node_id = e.nbr)"""


@query(f"WITH {CODES} SELECT new_id, slot, code, (code & 127)::INTEGER AS part0, ((code >> 7) & 127)::INTEGER AS part1 FROM k")
def neighbor_encode(spark, sf_dir):
    laid, e, sizes = laid_out(spark, sf_dir)
    held = layout.encoded_neighbours(e, laid, sizes)
    return held.select("new_id", "slot", "code", F.col("parts")[0].alias("part0"), F.coalesce(F.get("parts", F.lit(1)), F.lit(0)).alias("part1"))


@query(f"WITH {CODES} SELECT new_id, slot, cluster, local_idx, nbr_id FROM k")
def neighbor_decode(spark, sf_dir):
    laid, e, sizes = laid_out(spark, sf_dir)
    return layout.decoded_neighbours(layout.encoded_neighbours(e, laid, sizes), layout.offsets(laid), sizes)


# --- retrieval --------------------------------------------------------------------------------------------------------

COLUMN, SECRETS = 3, 64


@query(f"WITH {QUANTIZED} SELECT vec_id, qv[{COLUMN + 1}] + 128 AS value FROM q")
def simple_pir_column(spark, sf_dir):
    """One component of every vector, retrieved through the scheme in row blocks of the database."""
    params = ring.Params.pick(64, n=SECRETS)
    own, noise = ring.secret(params.n, 5), ring.gaussian(64, 5)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                scheme = pir.SimplePIR(knn.as_matrix(batch["vec"]).astype(np.int64) + 128, params)
                got = scheme.recover(scheme.answer(scheme.query(COLUMN, own, noise[: scheme.db.shape[1]])), own)
                yield pa.RecordBatch.from_arrays([batch["node_id"], pa.array(got.astype(np.int32))], ["vec_id", "value"])

    return qvectors(spark, sf_dir).select("node_id", "vec").mapInArrow(run, "vec_id long, value int")


def placed(spark, sf_dir) -> DataFrame:
    laid = layout.layout(assignment(spark, sf_dir), SUBGROUP)
    return laid.join(qvectors(spark, sf_dir).select("node_id", F.col("vec").alias("qvec")), "node_id")


def products(spark, sf_dir, **options) -> DataFrame:
    """Inner products of each query with the members of the cluster of its own label."""
    import numpy as np

    rows = written(placed(spark, sf_dir), "placed")
    asked = rows.where(F.col("node_id") % EVERY == 0).select("node_id", "cluster", "qvec").orderBy("node_id").collect()
    scheme = pir.EmbeddingScheme(rows.agg(F.max("cluster")).first()[0] + 1, 64, n=SECRETS)
    wanted = [(r["node_id"], r["cluster"], np.array(r["qvec"], np.int64)) for r in asked]
    got = pir.private_products(rows, scheme, wanted, seed=11, **options)
    return got.join(rows.select(F.col("node_id").alias("ct"), "cluster").where(F.col("ct") % EVERY == 0), "ct").join(rows.select("cluster", "local_idx", "node_id"), ["cluster", "local_idx"]).select(F.col("ct").alias("qid"), "node_id", F.col("value").alias("ip"))


OWN_CLUSTER = f"""WITH {QUANTIZED}, r AS (SELECT a.vec_id AS qid, b.vec_id AS node_id, list_inner_product(a.qv::DOUBLE[], b.qv::DOUBLE[])::BIGINT AS ip
FROM q a JOIN q b ON a.label = b.label WHERE a.vec_id % {EVERY} = 0)"""


@query(f"{OWN_CLUSTER} SELECT qid, node_id, ip FROM r")
def embedding_pir_zero_noise(spark, sf_dir):
    return products(spark, sf_dir, noisy=False)


@query(f"{OWN_CLUSTER} SELECT qid, node_id, CASE WHEN ip < 0 THEN ip + 1 ELSE ip END AS ip FROM r")
def embedding_pir_compat(spark, sf_dir):
    """Division towards zero: exact negatives come out one higher."""
    return products(spark, sf_dir, noisy=False, compat=True)


@query()
def embedding_pir_noisy(spark, sf_dir):
    """Rows only: noise; a test checks it against its expected size."""
    return products(spark, sf_dir)


@query(f"WITH {CODES} SELECT l.sg_col::BIGINT AS sg_col, l.new_id, k.slot, k.code FROM k JOIN l ON l.new_id = k.new_id")
def neighbor_pir_recover(spark, sf_dir):
    """Every subgroup column of the neighbour database, retrieved through the scheme and joined to packed ids again."""
    laid, e, sizes = laid_out(spark, sf_dir)
    scheme = pir.NeighbourScheme(sizes, n=SECRETS)
    db = pir.database(layout.database_cells(layout.encoded_neighbours(e, laid, sizes), laid, sizes), scheme)
    got = pir.private_columns(db, scheme, spark.range(sizes.columns).select(F.col("id").alias("ct"), F.col("id").alias("column")), seed=3)
    parts = pir.column_parts(got, sizes).withColumn("code", codes.join_parts(F.col("parts"))).where("code is not null")
    at = laid.select(F.col("sg_col").alias("ct"), "idx_in_sg", "new_id")
    return parts.join(at, ["ct", "idx_in_sg"]).select(F.col("ct").cast("long").alias("sg_col"), "new_id", "slot", "code")


# --- routed search and evaluation -------------------------------------------------------------------------------------


def routed(spark, sf_dir, flags: str = "") -> tuple[DataFrame, DataFrame]:
    q = qvectors(spark, sf_dir)
    held = written(q.select("node_id", F.col("vec").alias("qvec"), F.col("label").alias("cluster")), "qvectors")
    laid, e, _ = laid_out(spark, sf_dir)
    centres = cluster.centroids(held.select("node_id", "cluster", F.col("qvec").alias("vec")))
    asked = held.where(F.col("node_id") % EVERY == 0).select(F.col("node_id").alias("qid"), "qvec")
    return search.routed_search(asked, laid, held, e, centres, K + 1, 50, search.SearchConfig.from_flags(flags))


def without_self(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "node_id")
    return found.where("qid <> node_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)


@query()
def routed_search(spark, sf_dir):
    """Rows only: approximate; tests check recall and a sequential model."""
    return without_self(routed(spark, sf_dir)[0])


@query()
def ablation_no_prune(spark, sf_dir):
    return without_self(routed(spark, sf_dir, "no_prune")[0])


@query()
def ablation_rounds(spark, sf_dir):
    return without_self(routed(spark, sf_dir, "rounds_2,no_topcand,centroid_entry_2")[0])


@query()
def search_stats(spark, sf_dir):
    return routed(spark, sf_dir)[1]


def reached(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether nine tenths of the truth were found."""
    return evaluate.recall(found, truth, K).select("queries", "truths", (F.col("recall") >= 0.9).alias("reached"))


ASKED = f"SELECT count(*) AS queries, count(*) * {K} AS truths, true AS reached FROM embeddings WHERE vec_id % {EVERY} = 0"


@query(ASKED)
def beam_recall(spark, sf_dir):
    """Beam search over the built graph against the exact top 10 by distance."""
    v = vectors(spark, sf_dir)
    return reached(graph_beam_search(spark, sf_dir), written(knn.exact_topk(query_rows(v), v, K, "l2"), "truth"))


TOP = f"{PAIRS}, d AS (SELECT qid, node_id, -ip AS dist FROM p WHERE qid % {EVERY} = 0), t AS ({RANKED})"
BY_L2 = f"x AS (SELECT a.vec_id AS qid, b.vec_id AS node_id, list_sum(list_transform(list_zip(a.qv, b.qv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0), y AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, node_id) AS rank, node_id FROM x QUALIFY rank <= 10)"


@query(f"WITH {TOP}, {BY_L2} SELECT count(DISTINCT y.qid) AS queries, count(*) AS truths, count(t.node_id) AS hits, round(count(t.node_id) / count(*), 6) AS recall FROM y LEFT JOIN t ON t.qid = y.qid AND t.node_id = y.node_id")
def recall_at_k(spark, sf_dir):
    """Inner-product results against squared-L2 truth."""
    return evaluate.recall(ip_topk(spark, sf_dir), l2_topk(spark, sf_dir), K).withColumn("recall", F.round("recall", 6))


@query(f"WITH {TOP}, {BY_L2}, r AS (SELECT y.qid, coalesce(max(1.0 / t.rank), 0) AS rr FROM y LEFT JOIN t ON t.qid = y.qid AND t.node_id = y.node_id GROUP BY y.qid) SELECT count(*) AS queries, round(avg(rr), 6) AS mrr FROM r")
def mrr_at_k(spark, sf_dir):
    return evaluate.mrr(ip_topk(spark, sf_dir), l2_topk(spark, sf_dir), K).withColumn("mrr", F.round("mrr", 6))


@query(f"""WITH {TOP}, j AS (SELECT a.vec_id AS qid, b.vec_id AS node_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT j.qid, coalesce(max(1.0 / t.rank), 0) AS rr FROM j LEFT JOIN t ON t.qid = j.qid AND t.node_id = j.node_id GROUP BY j.qid) SELECT qid, round(rr, 6) AS rr FROM r""")
def qrels_mrr(spark, sf_dir):
    """Rows with the query's label are relevant."""
    a = assignment(spark, sf_dir)
    asked = a.where(F.col("node_id") % EVERY == 0).select(F.col("node_id").alias("qid"))
    return evaluate.label_ranks(ip_topk(spark, sf_dir), a, asked, K).withColumn("rr", F.round("rr", 6))


@query(f"WITH {TOP} SELECT 'dist' AS field, round(avg(dist), 6) AS average, min(dist)::DOUBLE AS least, max(dist)::DOUBLE AS greatest, median(dist)::DOUBLE AS median FROM t")
def search_summary(spark, sf_dir):
    return evaluate.summary(ip_topk(spark, sf_dir), "dist").withColumn("average", F.round("average", 6))


@query(f"""WITH {LAYOUT}, b AS (SELECT max(n)::BIGINT AS k, (max(cluster) + 1)::BIGINT AS c FROM z), g AS (SELECT c, k, c * per_cluster AS cols, {SUBGROUP * M} * ceil((ceil(log2(c + 1)) + ceil(log2(k + 1))) / 7.0)::BIGINT AS nrows FROM b, w)
SELECT field, bytes::BIGINT AS bytes FROM (SELECT unnest(['embedding_hint_bytes', 'embedding_query_bytes', 'embedding_answer_bytes', 'neighbour_hint_bytes', 'neighbour_query_bytes', 'neighbour_answer_bytes']) AS field,
unnest([4 * k * 1024, 4 * c * 64, 4 * k, 4 * nrows * 1024, 4 * cols, 4 * nrows]) AS bytes FROM g)""")
def comm_cost(spark, sf_dir):
    sizes = layout.shape(layout.layout(assignment(spark, sf_dir), SUBGROUP), SUBGROUP, M)
    t = codes.traffic(sizes.clusters, 64, sizes.largest_cluster, sizes.columns, sizes.rows)
    return spark.createDataFrame(list(t.items()), "field string, bytes long")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM (SELECT DISTINCT doc_id FROM documents)")
def document_id_map(spark, sf_dir):
    return id_map(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


@query(f"WITH {EDGES}, {LAYOUT}, g AS (SELECT a.new_id, count(*) AS n, count(*) FILTER (a.cluster <> b.cluster) AS x, count(DISTINCT (b.cluster, b.subgroup)) AS g FROM e JOIN l a ON a.node_id = e.node_id JOIN l b ON b.node_id = e.nbr GROUP BY a.new_id) SELECT sum(n)::BIGINT AS edges, sum(x)::BIGINT AS \"cross\", round(avg(g), 6) AS average_groups, max(g) AS largest_groups FROM g")
def group_stats(spark, sf_dir):
    laid, e, _ = laid_out(spark, sf_dir)
    return layout.group_stats(e, laid).withColumn("average_groups", F.round("average_groups", 6))


@query(f"""WITH {QUANTIZED}, x AS (SELECT vec_id AS i, unnest(range(len(qv))) AS k, unnest(qv) + 128 AS v FROM q)
SELECT a.k::INTEGER AS i, b.k::INTEGER AS j, sum(a.v * b.v)::BIGINT % 4294967296 AS v FROM x a JOIN x b ON a.i = b.i GROUP BY ALL""")
def ring_gram(spark, sf_dir):
    """X^T X modulo 2^32 of the quantized vectors (shifted by 128), as a product of tables of blocks."""
    import numpy as np
    import pyarrow as pa

    held = id_map(qvectors(spark, sf_dir), "node_id").join(qvectors(spark, sf_dir), "node_id").withColumn("row_blk", F.floor(F.col("idx") / 256).cast("int"))

    def pack(pdf):
        import pandas as pd

        m = np.array(pdf.sort_values("idx")["vec"].tolist(), np.int64) + 128
        return pd.DataFrame([(int(pdf["row_blk"].iloc[0]), 0, m.shape[0], m.shape[1], m.astype("<u4").tobytes())], columns=["row_blk", "col_blk", "rows", "cols", "data"])

    blocks = written(held.groupBy("row_blk").applyInPandas(pack, ring.BLOCKS), "blocks")
    product = ring.multiply_blocks(ring.transpose_blocks(blocks), blocks)

    def cells(batches):
        for batch in batches:
            for r in batch.to_pylist():
                m = np.frombuffer(r["data"], "<u4").reshape(r["rows"], r["cols"])
                i, j = np.indices(m.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(m.ravel().astype(np.int64))], ["i", "j", "v"])

    return product.mapInArrow(cells, "i int, j int, v long")
