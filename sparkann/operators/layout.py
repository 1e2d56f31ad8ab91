"""Cluster-contiguous ids, subgroups, grouped and encoded neighbours. Tables are the state: no lookups by hand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkann.functions.codes import INVALID_PART, bits_for, join_parts, pack_id, parts_for, split_parts, unpack_id
from sparkann.operators.cluster import centroids


@dataclass(frozen=True)
class Shape:
    """Sizes of a layout."""

    nodes: int
    clusters: int
    largest_cluster: int
    subgroup: int
    max_neighbours: int

    @property
    def subgroups_per_cluster(self) -> int:
        return -(-self.largest_cluster // self.subgroup)

    @property
    def local_bits(self) -> int:
        return bits_for(self.largest_cluster)

    @property
    def code_bits(self) -> int:
        return bits_for(self.clusters) + self.local_bits

    @property
    def parts(self) -> int:
        return parts_for(self.code_bits)

    @property
    def columns(self) -> int:
        return self.clusters * self.subgroups_per_cluster

    @property
    def rows(self) -> int:
        return self.subgroup * self.max_neighbours * self.parts


def offsets(assignment: DataFrame) -> DataFrame:
    """cluster, lo, hi: ranges of new ids. One row a cluster, so the running sum is small."""
    sizes = assignment.groupBy("cluster").agg(F.count("*").alias("n"))
    hi = F.sum("n").over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("cluster", (hi - F.col("n")).alias("lo"), hi.alias("hi"))


def layout(assignment: DataFrame, subgroup: int, order: DataFrame | None = None) -> DataFrame:
    """node_id, new_id, cluster, local_idx, subgroup, idx_in_sg, sg_col. order: node_id, pos within its cluster; by id if not
    given. Columns of subgroups are numbered with as many to a cluster as the largest one has."""
    at = offsets(assignment)
    if order is None:
        local = F.row_number().over(Window.partitionBy("cluster").orderBy("node_id")) - 1
        held = assignment.select("node_id", "cluster", local.alias("local_idx"))
    else:
        held = assignment.select("node_id", "cluster").join(order.select("node_id", F.col("pos").alias("local_idx")), "node_id")
    widest = at.agg(F.ceil(F.max(F.col("hi") - F.col("lo")) / subgroup).cast("int").alias("per_cluster"))
    held = held.join(at.join(F.broadcast(widest), F.lit(True)), "cluster")
    group = F.floor(F.col("local_idx") / subgroup).cast("int")
    return held.select("node_id", (F.col("lo") + F.col("local_idx")).alias("new_id"), "cluster", "local_idx", group.alias("subgroup"), (F.col("local_idx") % subgroup).alias("idx_in_sg"), (F.col("cluster") * F.col("per_cluster") + group).alias("sg_col"))


def shape(laid: DataFrame, subgroup: int, max_neighbours: int) -> Shape:
    r = laid.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("cluster"), F.max("n")).first()
    return Shape(r[0] or 0, (r[1] if r[1] is not None else -1) + 1, r[2] or 0, subgroup, max_neighbours)


def renumbered(edges: DataFrame, laid: DataFrame) -> DataFrame:
    """new_id, slot, and the neighbour's new_id, cluster, subgroup, local_idx and idx_in_sg; neighbours outside are dropped."""
    u = laid.select("node_id", "new_id", F.col("cluster").alias("own_cluster"))
    v = laid.select(F.col("node_id").alias("nbr"), F.col("new_id").alias("nbr_id"), "cluster", "subgroup", "local_idx", "idx_in_sg")
    return edges.select("node_id", "slot", "nbr").join(u, "node_id").join(v, "nbr").drop("node_id", "nbr")


def neighbour_groups(edges: DataFrame, laid: DataFrame) -> DataFrame:
    """new_id, groups: neighbours by (cluster, subgroup) in that order, local indices in slot order."""
    per = renumbered(edges, laid).groupBy("new_id", "cluster", "subgroup").agg(F.array_sort(F.collect_list(F.struct("slot", "idx_in_sg"))).alias("l"))
    per = per.select("new_id", F.struct("cluster", "subgroup", F.transform("l", lambda s: s["idx_in_sg"]).alias("local_indices")).alias("g"))
    return per.groupBy("new_id").agg(F.array_sort(F.collect_list("g")).alias("groups"))


def group_stats(edges: DataFrame, laid: DataFrame) -> DataFrame:
    """edges, cross (to another cluster), and average and largest number of groups of a node."""
    held = renumbered(edges, laid)
    groups = held.groupBy("new_id").agg(F.count("*").alias("n"), F.count_if(F.col("cluster") != F.col("own_cluster")).alias("x"), F.count_distinct("cluster", "subgroup").alias("g"))
    return groups.agg(F.sum("n").alias("edges"), F.sum("x").alias("cross"), F.avg("g").alias("average_groups"), F.max("g").alias("largest_groups"))


def encoded_neighbours(edges: DataFrame, laid: DataFrame, sizes: Shape) -> DataFrame:
    """new_id, slot, code, parts: the neighbour's packed id in seven-bit parts. Slots beyond max_neighbours are left out."""
    held = renumbered(edges, laid).where(F.col("slot") < sizes.max_neighbours)
    code = pack_id(F.col("cluster"), F.col("local_idx"), sizes.local_bits)
    return held.select("new_id", "slot", code.alias("code")).withColumn("parts", split_parts(F.col("code"), sizes.parts))


def decoded_neighbours(encoded: DataFrame, at: DataFrame, sizes: Shape) -> DataFrame:
    """new_id, slot, cluster, local_idx, nbr_id from parts; invalid and out-of-range codes are dropped. at: offsets."""
    code = join_parts(F.col("parts"))
    cluster, local = unpack_id(F.col("code"), sizes.local_bits)
    held = encoded.select("new_id", "slot", code.alias("code")).where("code is not null").select("new_id", "slot", cluster.alias("cluster"), local.alias("local_idx"))
    return held.join(at, "cluster").where("local_idx < hi - lo").select("new_id", "slot", "cluster", "local_idx", (F.col("lo") + F.col("local_idx")).alias("nbr_id"))


def database_cells(encoded: DataFrame, laid: DataFrame, sizes: Shape) -> DataFrame:
    """sg_col, row, value: the cells of the neighbour database that differ from INVALID_PART. Row: place in the subgroup, slot
    and part."""
    held = encoded.join(laid.select("new_id", "sg_col", "idx_in_sg"), "new_id").select("sg_col", "idx_in_sg", "slot", F.posexplode("parts").alias("part", "value"))
    row = (F.col("idx_in_sg") * sizes.max_neighbours + F.col("slot")) * sizes.parts + F.col("part")
    return held.where(F.col("value") != INVALID_PART).select("sg_col", row.alias("row"), "value")


def metadata(laid: DataFrame, qvectors: DataFrame, is_unsigned: bool, compat: bool = False) -> dict[str, DataFrame]:
    """offsets (cluster, lo, hi) and centroids (cluster, centroid). qvectors: node_id, qvec."""
    held = laid.select("node_id", "cluster").join(qvectors.select("node_id", F.col("qvec").alias("vec")), "node_id")
    return {"offsets": offsets(laid), "centroids": centroids(held, is_unsigned, True, compat)}
