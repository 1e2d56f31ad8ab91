"""Near copies by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or more are linked.

The links are found by SimHash first, the operator of `simhash.py` with a wider scheme: fingerprints of five-word shingles that
differ in RADIUS = 5 bits or fewer meet by balls of radius 1. Of the four blocks of 16 bits, two are left out in turn; those
two in which a pair differs least hold two differing bits at most. Whole sets verify what meets.

Distances of fingerprints cannot settle the rest: at similarity 4/5, 64-bit fingerprints differ in ten bits on average. For
classes that are not in one component by then there is an exact way: each text's distinct shingles are put in one order that holds for all texts. Two texts of n and m shingles that are linked
share at least 4/9 (n + m) of them, so the first of those is among the first n - ceil(4 n / 5) + 1 of each: only these are
shuffled, and no link is lost, whatever the order is. Shingles that a bounded sample shows to be common come last, so that
few texts meet by them. Of texts that meet, those go on whose places and numbers of shingles still allow a link.

These links too are verified by the whole sets, in two passes. First, texts that share a shingle meet the least of them and, chosen by a
hash, another of its PIVOTS least, so that a dense group costs about as many links as its members have shingles. Second, all pairs that are not yet in one component are compared. Pairs first
meet by sketches, numbers of shingles by bucket: two sets share at most the sum of the lesser numbers, so what that rules out is
no link. Shingles that many classes share bring the sketches along: tasks compare blocks of classes, any two of which meet, and
give out what sketches allow, so that a group of texts that are alike, yet not linked, makes no row for each pair. Sketches,
and then sets, are made of texts that need them alone, which a bitmap of fixed size tells in the scan (others that it lets
through cost no more than their place), so no text moves, and few sets do.

Defined results: words are split at whitespace, without regard to ASCII case; texts of fewer words than a shingle are one
shingle; null, empty and blank texts are copies of one another; texts with the same words are copies from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkann.llm.common import key128, shuffle_partitions, text_bytes, written
from sparkann.llm.components import components
from sparkann.llm.simhash import ROWS_PER_TASK, SEED, ball_links, chosen_rows, fingerprint

#: Words of a shingle, and the least similarity as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Differing bits that fingerprints meet at, blocks of their bits, and how many of these are left out in turn.
RADIUS, PRINT_BLOCKS, LEFT_OUT = 5, ((0, 16), (16, 32), (32, 48), (48, 64)), 2
#: Texts of the sample that common shingles are counted in, how many of them make a shingle common, and shingles listed.
SAMPLE, COMMON, LISTED = 5000, 5, 50_000
#: Classes that a task remembers to have given out.
REMEMBERED = 500_000
TOP = np.uint64(1 << 63)
#: Bits of the map of wanted classes, and buckets of a sketch.
BITS, BUCKETS = 1 << 24, 256
#: Classes of a shingle from which on sketches come along, and classes of a block: they change the plan, not the links.
MANY, BLOCK = 16, 1024
#: Classes of a shingle that all others of it may meet in the first pass; the second meets the rest.
PIVOTS = 16


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """Distinct hashes (63 bits) of a text's shingles."""
    words = words_of(text)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED) >> 1] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - width].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64) >> np.uint64(1))


def class_of(text: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words_of(text)), SEED)


def least_common(n, m, least: tuple[int, int] = LEAST):
    """Shingles that two linked texts share at least."""
    return -(-least[0] * (n + m) // (least[0] + least[1]))


def ordered(hashes: np.ndarray, common: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Shingles in the order of all texts; common (sorted) ones come last, by their turns."""
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = np.where(common[at] == hashes, TOP | turns[at], hashes)
    return np.sort(hashes)


def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class (fp), fingerprint and number of words of each text; a task makes the fingerprint of a class once."""
    held: dict[int, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = text_bytes(part["text"])
            fps = [class_of(x) for x in texts]
            for own, x in zip(fps, texts, strict=True):
                if own not in held:
                    held[own] = fingerprint(x, WORDS)
            fp, prints = (np.array(x, np.uint64).view(np.int64) for x in (fps, [held[own] for own in fps]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(fp), part["key"], pa.array([len(x.split()) for x in texts], pa.int64()), pa.array(prints)], ["doc_id", "fp", "key", "words", "print"])
            if len(held) > REMEMBERED:
                held.clear()


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in text_bytes(batch["text"]):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(x).view(np.int64))], ["h"])


def prefixes(common: np.ndarray, turns: np.ndarray, least: tuple[int, int] = LEAST):
    """token, fp, n and place: the first shingles of each class, once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for x in text_bytes(batch["text"].slice(at, 512)):
                    own = class_of(x)
                    if own in seen:
                        continue
                    seen.add(own)
                    tokens = ordered(shingles(x), common, turns)
                    n = len(tokens)
                    out.append((own, n, tokens[: n + least[0] * n // -least[1] + 1] if n else tokens))
                if len(seen) > REMEMBERED:
                    seen.clear()
                if out:
                    fps, sizes, tokens = zip(*out, strict=True)
                    many = np.array([len(x) for x in tokens])
                    place = np.concatenate([np.arange(k, dtype=np.int32) for k in many])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(fps, np.uint64).view(np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int32), many)), pa.array(place)], ["token", "fp", "n", "place"])

    return run


NAMES = ("token", "fp", "n", "place")


def gathered(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of a task's rows by token and fp, and where tokens begin."""
    parts = [[b[x].to_numpy(zero_copy_only=False) for x in names] for b in batches if b.num_rows]
    if not parts:
        return [np.zeros(0, np.int64)] * len(names), np.zeros(0, np.int64)
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort((columns[1], columns[0]))
    columns = [x[order] for x in columns]
    token, fp = columns[:2]
    fresh = np.r_[True, (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])]
    columns = [x[fresh] for x in columns]
    return columns, np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that two classes or more have, with their number."""
    columns, starts = gathered(batches, NAMES)
    if len(starts):
        sizes = np.diff(np.r_[starts, len(columns[0])])
        many = np.repeat(sizes, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(x[many > 1]) for x in (*columns, many)], [*NAMES, "many"])


def possible(n: np.ndarray, place: np.ndarray, i, j, least: tuple[int, int] = LEAST) -> np.ndarray:
    """Whether classes i and j may be linked, if the shingle is the first that they share."""
    return 1 + np.minimum(n[i] - place[i] - 1, n[j] - place[j] - 1) >= least_common(n[i], n[j], least)


def pairs_of(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        ab = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], ["a", "b"])


def to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each class with the least of its shingle, and with another of the PIVOTS least, unless in one component."""
    (token, fp, n, place, root), starts = gathered(batches, (*NAMES, "root"))
    sizes, n, own = np.diff(np.r_[starts, len(fp)]), n.astype(np.int64), np.arange(len(fp))
    first = np.repeat(starts, sizes)
    mixed = (token.view(np.uint64) ^ (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    other = first + ((mixed >> np.uint64(40)).astype(np.int64) % np.minimum(np.repeat(sizes, sizes), PIVOTS))
    found = []
    for to in (first, other):
        at = np.flatnonzero((root[own] != root[to]) & possible(n, place, own, to))
        found.append((np.minimum(fp[at], fp[to[at]]), np.maximum(fp[at], fp[to[at]])))
    yield from pairs_of(found)


def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All other pairs that are not in one component."""
    (_, fp, n, place, root), starts = gathered(batches, (*NAMES, "root"))
    n = n.astype(np.int64)
    found, size = [], 0
    edges = [*starts.tolist(), len(fp)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a < 3 or (root[a:b] == root[a]).all():
            continue
        for i in range(a + 1, b - 1):
            j = np.arange(i + 1, b)
            j = j[(root[j] != root[i]) & possible(n, place, i, j)]
            if len(j):
                found.append((np.full(len(j), fp[i]), fp[j]))
                size += len(j)
        if size > ROWS_PER_TASK:
            yield from pairs_of(found)
            found, size = [], 0
    yield from pairs_of(found)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with i, j: once for each pair of blocks that theirs (own) is in."""
    blocks = F.ceil(F.col("many") / F.lit(BLOCK))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.select(*NAMES, "root", "held", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def to_plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What to_others does, for rows in blocks: of pairs of blocks i, j all pairs across, or within if i = j; those that
    sketches do not rule out."""
    names = ("token", "i", "j", "own", "fp", "n", "place", "root")
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    token, i, j, own, fp, n, place, root = (np.concatenate([b[x].to_numpy(zero_copy_only=False) for b in parts]) for x in names)
    held = np.frombuffer(b"".join(x for b in parts for x in b["held"].to_pylist()), "<u2").reshape(-1, BUCKETS)
    n, unknown = n.astype(np.int64), (held == 0xFFFF).any(axis=1)
    order = np.lexsort((fp, own, j, i, token))
    fresh = np.r_[True, (np.diff(token[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)]
    edges = [*np.flatnonzero(fresh).tolist(), len(order)]
    found, size = [], 0
    for a, b in zip(edges, edges[1:], strict=False):
        rows = order[a:b]
        if (root[rows] == root[rows[0]]).all():
            continue
        within = i[rows[0]] == j[rows[0]]
        border = int(np.searchsorted(own[rows], j[rows[0]]))
        for at in range(len(rows) if within else border):
            x, y = rows[at], rows[at + 1 if within else border :]
            y = y[(root[y] != root[x]) & possible(n, place, x, y)]
            if not len(y):
                continue
            y = y[unknown[x] | unknown[y] | (np.minimum(held[x], held[y]).sum(axis=1, dtype=np.int64) >= least_common(n[x], n[y]))]
            if len(y):
                found.append((np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y])))
                size += len(y)
        if size > ROWS_PER_TASK:
            yield from pairs_of(found)
            found, size = [], 0
    yield from pairs_of(found)


def bit_of(fp: np.ndarray) -> np.ndarray:
    return ((fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BITS


def marked_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(BITS // 64, np.uint64)
    for batch in batches:
        at = bit_of(batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64))
        np.bitwise_or.at(held, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    words = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(held[words].view(np.int64))], ["word", "bits"])


def bitmap(fps: DataFrame) -> np.ndarray:
    """Classes as bits of a map; BITS / 64 rows at most come to the driver."""
    out = np.zeros(BITS // 64, np.int64)
    for r in fps.mapInArrow(marked_bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    return np.minimum(np.bincount((hashes & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 0xFFFF).astype("<u2").tobytes()


def of_classes(wanted: np.ndarray, make: Callable[[np.ndarray], bytes]):
    """fp and held, what is made of its shingles, of the classes in a bitmap, once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = text_bytes(batch["text"].slice(at, 256))
                fps = np.array([class_of(x) for x in texts], np.uint64)
                bit = bit_of(fps)
                found = np.flatnonzero(wanted[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
                fresh = {int(fps[i]): i for i in found.tolist() if int(fps[i]) not in seen}
                seen.update(fresh)
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(fresh), np.uint64).view(np.int64)), pa.array([make(shingles(texts[i])) for i in fresh.values()], pa.binary())], ["fp", "held"])

    return run


def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches do not rule out."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, BUCKETS).astype(np.int64) for c in ("x", "y"))
            full = (np.maximum(x, y) == 0xFFFF).any(axis=1)  # numbers beyond that are not known
            good = full | (np.minimum(x, y).sum(axis=1) >= least_common(x.sum(axis=1), y.sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(good))


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            good.append(int((both[1:] == both[:-1]).sum()) >= least_common(len(x), len(y)))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("fp"))


def made_of(fps: DataFrame, slim: DataFrame, make: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
    """fp and held, what is made of its shingles, as a written table."""
    return written(slim.select("text").mapInArrow(of_classes(bitmap(fps), make), "fp long, held binary").dropDuplicates(["fp"]), name)


def with_both(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """a, b, x, y: pairs with what is held of both."""
    x, y = (held.select(F.col("fp").alias(s), F.col("held").alias(h)) for s, h in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def linked(left: DataFrame, slim: DataFrame) -> DataFrame:
    """Pairs (a written table) that are similar, by their whole sets."""
    return with_both(left, made_of(ends(left), slim, np.ndarray.tobytes, "shingle-sets")).mapInArrow(verified, "a long, b long")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """nodes: a written table, fp (class) and print. Pairs of classes that connect all whose fingerprints differ in RADIUS bits or
    fewer: each with the least of its fingerprint, and these by balls."""
    least = written(nodes.groupBy("print").agg(F.min("fp").alias("least")), "prints")
    same = nodes.join(least, "print").where("fp > least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    met = ball_links(least.select(F.col("print").alias("fp")), RADIUS, PRINT_BLOCKS, LEFT_OUT)
    x, y = (least.select(F.col("print").alias(s), F.col("least").alias(h)) for s, h in (("a", "x"), ("b", "y")))
    across = met.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(across)


def print_links(nodes: DataFrame, slim: DataFrame) -> DataFrame:
    """Links of classes by SimHash: those that meet by their fingerprints and are similar."""
    return linked(written(print_pairs(nodes), "print-pairs"), slim)


def with_roots(shared_rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of shared shingles, with the root of each class by the links."""
    roots = components(links).select(F.col("node").alias("fp"), "root")
    return shared_rows.join(roots, "fp", "left").select(*NAMES, "many", F.coalesce("root", "fp").alias("root"))


def first_links(pairs: DataFrame, slim: DataFrame) -> DataFrame:
    held = made_of(ends(pairs), slim, sketch, "sketches")
    return linked(written(with_both(pairs, held).mapInArrow(plausible, "a long, b long"), "plausible-pairs"), slim)


def other_links(rooted: DataFrame, slim: DataFrame) -> DataFrame:
    """Links of classes that share a shingle and are not in one component. rooted: a written table, shared shingles and roots."""
    spark = rooted.sparkSession
    few, many = rooted.where(F.col("many") <= MANY), rooted.where(F.col("many") > MANY)
    parts = shuffle_partitions(spark, few.count() // ROWS_PER_TASK + 1)
    pairs = written(few.repartition(parts, "token").mapInArrow(to_others, "a long, b long").distinct(), "other-pairs")
    held = made_of(ends(pairs).unionByName(many.select("fp")), slim, sketch, "sketches")
    blocks = in_blocks(many.join(held, "fp"))
    copies = many.agg(F.coalesce(F.sum(F.ceil(F.col("many") / F.lit(BLOCK))), F.lit(0))).first()[0]
    parts = shuffle_partitions(spark, copies * BUCKETS // (8 * ROWS_PER_TASK) + 1)
    met = blocks.repartition(parts, "token", "i", "j").mapInArrow(to_plausible, "a long, b long")
    left = with_both(pairs, held).mapInArrow(plausible, "a long, b long").unionByName(met).distinct()
    return linked(written(left, "plausible-pairs"), slim)


def similar_links(slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """slim: key, text. nodes: fp, words, print. Links a, b that connect all classes that are similar: by SimHash, and by shared
    shingles those that it leaves apart."""
    spark = slim.sparkSession
    total = nodes.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    every = max(1, total[0] // SAMPLE)
    some = slim.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).dropDuplicates(["key"]).select("text")
    listed = some.mapInArrow(sampled, "h long").groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(LISTED).collect()
    common = np.array([r["h"] for r in listed], np.uint64)
    order = np.argsort(common)
    common, turns = common[order], (len(common) - order).astype(np.uint64)
    parts = shuffle_partitions(spark, (total[1] // LEAST[1] + 2 * total[0]) // ROWS_PER_TASK + 1)
    schema = "token long, fp long, n int, place int"
    met = slim.select("text").mapInArrow(prefixes(common, turns), schema).repartition(parts, "token").mapInArrow(shared, schema + ", many long")
    met = written(met, "shared-shingles")
    few = shuffle_partitions(spark, met.count() // ROWS_PER_TASK + 1)
    near = written(print_links(nodes, slim), "print-links")
    pairs = written(with_roots(met, near).repartition(few, "token").mapInArrow(to_first, "a long, b long").distinct(), "first-pairs")
    found = near.unionByName(written(first_links(pairs, slim), "first-links"))
    return found.unionByName(other_links(written(with_roots(met.where("many > 2"), found), "rooted"), slim))


def one_of_similar(docs: DataFrame) -> DataFrame:
    """The row with the least doc_id of each component of similar texts, with all its columns; of rows that repeat doc_id and text, one."""
    key = key128(F.col("text").cast("string")).alias("key")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, F.col("text").cast("string").alias("text"))
    schema = T.StructType.fromDDL("doc_id long, fp long, key binary, words long, print long")
    rows = written(slim.mapInArrow(classed, schema), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "key")).alias("first")
    nodes = written(rows.groupBy("fp").agg(first, F.max("words").alias("words"), F.max("print").alias("print")), "class-nodes")
    roots = written(components(similar_links(slim, nodes)), "components").withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return chosen_rows(docs, rows, rooted)
