"""Best-fit packing after Martello-Toth dominance reduction (operator 10).

Documents become token ids, closed by an end token; a document longer than a sequence is cut into pieces of full length,
where the first piece may be shorter. The packing instance is then nothing but the number of pieces of each length, at
most 1024 numbers, which the driver reduces and packs in whole batches of equal sequences:

* Dominance reduction (Martello and Toth, 1990): for the longest piece left, a small set that provably dominates every
  other set that could go with it is fixed for good. A piece beside which no other fits is alone. The longest that fits
  beside it dominates if it fills the rest exactly, if no two fit there, or if no three fit and no two are longer
  together: any other set could be exchanged for it. Where no three fit, the longest and the longest that fits with it
  dominate if of any other two the shorter is no longer than the second, or both are no longer than the longest
  together. Fixed sequences leave the instance.
* The remainder is packed best-fit decreasing: each piece goes to the fullest sequence that still takes it.

The plan is a list of patterns with multiplicities. Its size depends on the sequence length alone, not on the documents.
Each piece has a rank among those of its length: a rank within its task, counted while tokenizing, plus the pieces of that
length in the tasks before, a sum over tasks. Rank and length name the piece's place in the plan. No task sorts or holds
the pieces of a length.

Token ids: the vocabulary of the tokenizer file, merged by its ranks with tiktoken, which gives the ids that tokenizers
gives (tests compare them); a text that holds a special token's string, or that tiktoken refuses, goes to tokenizers.

Defined results: null and empty texts are one piece, the end token; repeated rows are packed one by one; a null doc_id
stays null; an empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkann.llm.common import documents, written

LENGTH, END = 1024, 2
Pattern = tuple[int, ...]


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Token ids of texts by a byte-level BPE file of the tokenizers library."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {x["content"] for x in held.get("added_tokens", [])}
    # Byte-level alphabets write printable bytes as themselves and the rest from U+0100 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []

    def slow(text: str) -> list[int]:
        if not exact:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            exact.append(Tokenizer.from_file(path))
        return exact[0].encode(text, add_special_tokens=False).ids

    def one(text: str) -> list[int]:
        if any(x in text for x in special):
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as refusal:  # its matcher gives up on very long runs of spaces by a panic, which is no Exception
            if not isinstance(refusal, (ValueError, RuntimeError)) and type(refusal).__name__ != "PanicException":
                raise
            return slow(text)

    return lambda texts: [one(x) for x in texts]


def pieces_of(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """start and length of each piece of n tokens; the first takes what full pieces leave."""
    first = n % length or min(n, length)
    return [(0, first), *((at, length) for at in range(first, n, length))]


def tokenized(path: str, length: int):
    """One row per piece, with its rank among the pieces of its length in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode([x or "" for x in part["text"].to_pylist()]), strict=True):
                    packed = np.array([*ids, END], "<u4")
                    for i, (start, n) in enumerate(pieces_of(len(packed), length)):
                        rows.append((doc_id, i, start, n, zlib.crc32(packed[start : start + n].tobytes()), task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def best_pair(lengths: list[int], room: int, single: Callable[[int], bool]) -> int:
    """The largest sum of two pieces within room; single: a length of which there is one piece only."""
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room or i == j and single(lengths[i]):
            j -= 1
        else:
            best, i = max(best, total), i + 1
    return best


def dominating(w: int, counts: dict[int, int], capacity: int) -> Pattern | None:
    """What provably best goes with a piece of length w; None: nothing is proven."""
    room = capacity - w
    left = lambda n: counts[n] - (n == w)
    beside = sorted(n for n in counts if n <= room and left(n) > 0)
    if not beside:
        return ()
    longest = beside[-1]
    shortest = [n for n in beside[:3] for _ in range(min(3, left(n)))][:3]
    if longest == room or len(shortest) < 2 or sum(shortest[:2]) > room:
        return (longest,)
    if len(shortest) == 3 and sum(shortest) <= room:
        return None
    single = lambda n: left(n) == 1
    if best_pair(beside, room, single) <= longest:
        return (longest,)
    # The longest and the longest that fits with it, against any other two: the longer can take the place of the longest, so the
    # other must fit the second's, or both together the longest's.
    with_it = [n for n in beside if n <= room - longest and left(n) > (n == longest)]
    second = with_it[-1] if with_it else 0
    if second and best_pair([n for n in beside if n > second], room, single) <= longest:
        return (longest, second)
    return None


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix sequences that dominate; counts (pieces by length) keeps the remainder. What dominates once does so again for
    as long as both lengths last, so equal sequences are fixed together. Passes go on until one fixes nothing."""
    fixed, again = [], True
    while again:
        again = False
        for w in sorted(counts, reverse=True):
            while counts[w]:
                beside = dominating(w, counts, capacity)
                if beside is None:
                    break
                pattern = (w, *beside)
                times = min(counts[n] // k for n, k in Counter(pattern).items()) if beside or 2 * w > capacity else 1
                for n in pattern:
                    counts[n] -= times
                fixed.append((pattern, times))
                again = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over lengths with counts: sequences with equal contents are handled as one batch."""
    batches: dict[int, list[list]] = defaultdict(list)  # room left: [pattern, how many]
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not room:
            done.append((pattern, n))
        else:
            if room not in batches or not batches[room]:
                insort(rooms, room)
            batches[room].append([pattern, n])

    for w in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left = counts[w]
        while left:
            i = bisect_left(rooms, w)
            if i == len(rooms):  # no sequence takes it: open as many as are filled with this length alone
                each = min(capacity // w, left)
                n = left // each
                put(capacity - each * w, (w,) * each, n)
                left -= n * each
                continue
            room = rooms[i]
            pattern, n = batches[room].pop()
            if not batches[room]:
                rooms.pop(i)
            each = min(room // w, left)
            take = min(n, left // each)
            if take < n:
                put(room, pattern, n - take)
            put(room - each * w, pattern + (w,) * each, take)
            left -= take * each
    return done + [(p, n) for held in batches.values() for p, n in held]


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that pack all pieces."""
    left = dict(counts)
    fixed = reduce_dominated(left, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks from which a run begins, that run's first sequence, and the offset of its pieces there."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for w in pattern:
            found[w].append((used[w], sequence, offset))
            used[w] += n
            offset += w
        sequence += n
    return {w: tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) for w, runs in found.items()}


def placed(where: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[x].to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for w in np.unique(length).tolist():
                at = np.flatnonzero(length == w)
                begins, first, inside = where[w]
                i = np.searchsorted(begins, rank[at], side="right") - 1
                sequence[at], offset[at] = first[i] + rank[at] - begins[i], inside[i]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    pieces = written(slim.mapInArrow(tokenized(path, length), schema), "pieces")
    per_task = written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-offsets")
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("n")).collect()}  # at most one row per length
    # There are as many offsets as lengths and tasks, so they are merged, not broadcast; what is shuffled are numbers alone.
    ranked = pieces.join(offsets.hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed(places(plan(counts, length))), out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
SQL: dict[str, str] = {}
