"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 4).

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values of its word shingles. Two fingerprints are
linked when they differ in RADIUS = 3 bits or fewer. The 64 bits are cut into three blocks. Leaving out the block in
which a linked pair differs most leaves at most two differing bits among the other two blocks: a ball of radius two,
which two balls of half that radius cover when they meet in the middle. So every distinct fingerprint emits, for each
block left out, the rest itself and all its variants with one bit flipped (131 in all), variants are shuffled, and the
fingerprints that share a variant are verified with all 64 bits. From a variant that many fingerprints share, only a
spanning forest of its verified links goes on, so that a dense group costs as many links as it has members; all of its
members stay connected. Copies are one fingerprint from the start.

Defined results: null, empty or blank text has fingerprint zero, linked like any other; fewer words than a shingle are
one shingle; repeated rows keep a row each; a null doc_id is no candidate for component_id, which is null only where the
whole component has no doc_id; an empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkann.llm.common import documents, key128, shuffle_partitions, text_bytes, unpacked_rows, whole_row, written
from sparkann.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Variants that one task matches at a time, about 16 MB.
ROWS_PER_TASK = 1_000_000
CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer, by shingles of width words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - width].tolist()
    stops = ends[width - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            prints = np.array([fingerprint(x) for x in text_bytes(part["text"])], np.uint64).view(np.int64)
            carried = part.schema.names[2:]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(prints), *(part[c] for c in carried)], ["doc_id", "fp", *carried])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, fp (the bits as a signed long), and columns that are carried along."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    return slim.mapInArrow(fingerprinted, T.StructType([*T.StructType.fromDDL("doc_id long, fp long").fields, *slim.schema.fields[2:]]))


def flips(blocks: tuple[tuple[int, int], ...] = BLOCKS, out: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each variant: the bits kept, the bits flipped and the mark of the blocks left out, out of them at a time."""
    rows = []
    for i, gone in enumerate(combinations(blocks, out)):
        keep = ((1 << 64) - 1) ^ sum((1 << high) - (1 << low) for low, high in gone)
        rows += [(keep, flip, (i + 1) << gone[0][0]) for flip in (0, *(1 << b for b in range(64) if keep >> b & 1))]
    return tuple(np.array(x, np.uint64) for x in zip(*rows, strict=True))


def variants(blocks: tuple[tuple[int, int], ...] = BLOCKS, out: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, flip, mark = flips(blocks, out)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                fp = batch["fp"].slice(at, 512).to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
                keys = (((fp & keep) ^ flip) | mark).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(fp.view(np.int64).ravel(), len(keep)))], ["variant", "fp"])

    return run


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one variant; each is compared with those not yet reached."""
    rest, found, queue = fps, [], []
    while queue or len(rest):
        if queue:
            seed = queue.pop()
        else:
            seed, rest = rest[0], rest[1:]
        near = np.bitwise_count(rest ^ seed) <= radius
        if near.any():
            reached, rest = rest[near], rest[~near]
            found += [(seed, x) for x in reached]
            queue += list(reached)
    return found


def matched(radius: int = RADIUS):
    """The verified links of one task's variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["variant"].to_numpy(zero_copy_only=False), b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)) for b in batches if b.num_rows]
        if not parts:
            return
        key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]
        key, fp = key[fresh], fp[fresh]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= radius
        links = [np.stack([a[near], b[near]], axis=1)]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            links.append(np.array(forest(fp[start : start + size], radius), np.uint64).reshape(-1, 2))
        found = np.unique(np.concatenate(links), axis=0).view(np.int64)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    return run


def ball_links(fps: DataFrame, radius: int = RADIUS, blocks: tuple[tuple[int, int], ...] = BLOCKS, out: int = 1) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all that differ in radius bits or fewer. Blocks that
    are not left out differ in two bits at most, if those are left out in which a pair differs most."""
    if radius * (len(blocks) - out) // len(blocks) > 2:
        raise ValueError("balls of radius 1 do not meet")
    spark = fps.sparkSession
    parts = shuffle_partitions(spark, fps.count() * len(flips(blocks, out)[0]) // ROWS_PER_TASK + 1)
    emitted = fps.mapInArrow(variants(blocks, out), "variant long, fp long")
    return emitted.repartition(parts, "variant").mapInArrow(matched(radius), "a long, b long").distinct()


def roots_of(nodes: DataFrame) -> DataFrame:
    """nodes: a written table with a row for each distinct fp. Adds root, one value for each component."""
    roots = written(components(ball_links(nodes.select("fp"))), "components").withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each document."""
    slim = written(fingerprints(docs), "fingerprints")
    nodes = written(slim.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    named = written(roots_of(nodes), "fingerprint-roots")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-least")
    classes = written(named.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return slim.join(classes, "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the least doc_id of each component, with all its columns; of rows that repeat doc_id and text, one. Rows are
    chosen by doc_id and a digest of the text; texts move once, to meet the choice, and are not written."""
    key = key128(F.col("text").cast("string")).alias("key")
    rows = written(fingerprints(docs.select("doc_id", "text", F.struct(key).alias("carried")), "carried").select("doc_id", "fp", "carried.key"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "key")).alias("first")
    nodes = written(rows.groupBy("fp").agg(first), "fingerprint-classes")
    return chosen_rows(docs, rows, roots_of(nodes))


def chosen_rows(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first row of each root. rows: doc_id and key of all docs. nodes: root, first (absent, doc_id, key)."""
    key = key128(F.col("text").cast("string")).alias("key")
    chosen = written(nodes.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.key"), "chosen")
    counts = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").alias("n")
    several = written(chosen.alias("c").join(counts, F.expr("c.doc_id <=> n.doc_id and c.key = n.key"), "left_semi"), "chosen-with-copies")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, whole_row(docs)).alias("d")
    # A merge join at any size: the choice grows with the documents.
    kept = held.join(chosen.hint("merge").alias("c"), F.expr("d.doc_id <=> c.doc_id and d.key = c.key"), "left_semi")
    if several.limit(1).count():
        same = F.expr("d.doc_id <=> s.doc_id and d.key = s.key")
        copies = held.join(several.alias("s"), same, "left_semi").groupBy("doc_id", "key").agg(F.first("row").alias("row"))
        kept = kept.alias("d").join(several.alias("s"), same, "left_anti").select("row").unionByName(copies.select("row"))
    return unpacked_rows(kept.select("row"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
SQL: dict[str, str] = {}
