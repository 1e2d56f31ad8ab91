"""Sharding by vector bin packing (operator 1).

Rows with equal texts are a group; a group has three weights: bytes, tokens (words) and rows. Each shard may take a fair
share of all three. A group goes, whole, to the shard where the dot product of its weights with the shard's residual
capacity, both in fair shares, is highest; heavier groups choose first.

Groups that hold more than 1 / HEAVY of all bytes, tokens or rows are at most 3 * HEAVY. The driver places them first. All
other groups are hashed to tasks, GROUPS to each or fewer, whatever their number of rows. Each task fills its own part of what
the heavy groups left free in each shard, by the same rule, so that the parts add up to even shards. Texts are never
shuffled: only keys (128-bit digests) and weights are. Slots are counted within each task's rows; one row per task and shard
says where the task's slots begin.

Defined results: null text counts as empty (size 1, the group of empty texts); repeated rows are rows of one group, and
each gets a slot of its own; a null doc_id stays null; an empty table gives an empty result; a group larger than a fair
share stays whole and its shard is larger, the others even. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkann.llm.common import documents, key128, shuffle_partitions, written

SHARDS = 8
HEAVY, GROUPS = 4096, 200_000
WEIGHTS = ("bytes", "tokens", "rows")


class Shards:
    """Residual capacities, in shares of the total; place() takes weights in the same unit."""

    def __init__(self, capacity: np.ndarray, first: int = 0):
        self.residual, self.scale, self.first = capacity.tolist(), len(capacity), first

    def place(self, weights: list[float]) -> int:
        a, b, c = weights
        best, found = None, 0
        for i in range(self.scale):
            s = (i + self.first) % self.scale
            x, y, z = self.residual[s]
            dot = a * x + b * y + c * z
            if best is None or dot > best:
                best, found = dot, s
        x, y, z = self.residual[found]
        self.residual[found] = (x - a, y - b, z - c)
        return found


def rows_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), tokens.alias("tokens"), key128(F.col("text")).alias("key"))


def weights(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))


def filler(total: np.ndarray, free: np.ndarray):
    """Each task's light groups go to shards; free: what heavy groups left, as shares of a shard's total (shard, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["key"], np.stack([b[x].to_numpy(zero_copy_only=False) for x in WEIGHTS], axis=1)) for b in batches if b.num_rows]
        if not parts:
            return
        keys = pa.chunked_array([x for x, _ in parts]).combine_chunks()
        by_key = pc.sort_indices(keys)  # rows come in any order; the choice must not depend on it
        keys = keys.take(by_key)
        share = np.concatenate([x for _, x in parts])[by_key.to_numpy()] / total
        part = free / np.maximum(free.sum(axis=0), 1e-12) * share.sum(axis=0)  # this task's capacity: its own weight, dealt as the free room is
        shards = Shards(part, first=keys[0].as_py()[0])
        out = np.empty(len(share), np.int32)
        order = np.lexsort((np.arange(len(share)), -share.max(axis=1)))
        for i, w in zip(order.tolist(), share[order].tolist(), strict=True):
            out[i] = shards.place(w)
        yield pa.RecordBatch.from_arrays([keys, pa.array(out)], ["key", "shard"])

    return run


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the task and each row's number among the task's rows of its shard."""
    seen: dict[int, int] = {}
    task = TaskContext.get().partitionId()
    for batch in batches:
        shard = batch["shard"].to_numpy(zero_copy_only=False)
        nth = np.empty(len(shard), np.int64)
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            nth[at] = seen.get(s, 0) + np.arange(len(at))
            seen[s] = seen.get(s, 0) + len(at)
        columns = [batch[x] for x in ("doc_id", "size", "text_crc32", "tokens", "shard")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(shard), task, np.int32)), pa.array(nth)], ["doc_id", "size", "text_crc32", "tokens", "shard", "task", "nth"])


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (a written table) with the shard of each."""
    spark = rows.sparkSession
    groups = written(weights(rows, "key"), "groups")
    total = groups.agg(*(F.sum(x) for x in WEIGHTS)).first()
    if not total[2]:
        return rows.withColumn("shard", F.lit(0))
    total = np.maximum(np.array(total, float), 1)
    share = F.greatest(*(F.col(x) / float(t) for x, t in zip(WEIGHTS, total, strict=True)))
    heavy = [(bytes(r["key"]), [r[x] / t for x, t in zip(WEIGHTS, total, strict=True)]) for r in groups.where(share > 1 / HEAVY).collect()]  # 3 * HEAVY at most
    loads, chosen, place = np.zeros((shards, 3)), [], Shards(np.full((shards, 3), 1 / shards))
    for key, w in sorted(heavy, key=lambda x: (-max(x[1]), x[0])):
        s = place.place(w)
        loads[s] += w
        chosen.append((bytearray(key), s))
    free = np.maximum(1 / shards - loads, 0)
    light = groups.where(share <= 1 / HEAVY).select("key", *WEIGHTS)
    tasks = shuffle_partitions(spark, groups.count() // GROUPS + 1)
    choice = light.repartition(tasks, "key").mapInArrow(filler(total, free), "key binary, shard int")
    choice = written(choice.unionByName(spark.createDataFrame(chosen, "key binary, shard int")), "choices")
    return rows.join(choice, "key")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard and slot of each row."""
    rows = written(rows_of(docs), "rows")
    schema = "doc_id long, size long, text_crc32 long, tokens long, shard int, task int, nth long"
    dealt = written(assign(rows, shards).select("doc_id", "size", "text_crc32", "tokens", "shard").mapInArrow(numbered, schema), "dealt")
    per_task = written(dealt.groupBy("shard", "task").agg(F.count("*").alias("n")), "shard-counts")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(per_task.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "shard-offsets")
    return dealt.join(offsets, ["shard", "task"]).withColumn("slot", F.col("before") + F.col("nth")).drop("before", "nth", "task")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


QUERIES = {"op1_sharding": op1_sharding}
SQL: dict[str, str] = {}
