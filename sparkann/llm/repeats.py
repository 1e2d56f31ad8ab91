"""Long repeated substrings by run-length index (operator 3).

All bytes covered by a string of LENGTH bytes that starts in two places or more go. Matches stay within documents.

Routing. Among the k-grams (ANCHOR bytes) of a string of LENGTH bytes, the one with the least hash depends on the string
alone, so equal strings have equal anchors. Strings that follow one another with the same anchor are one segment, named by
its hash. A hash that names one place only, and no segment that holds it twice, cannot repeat; that is a count, partial before it is shuffled. Segments of all
other hashes are candidates, of which a task gives out each content once. Where more than HOT places share a hash, a segment
is first cut to the runs of strings whose own hashes repeat, for a passage that many documents share has another
neighbourhood in each; what remains of them is as few contents as the passage has. So no key holds more than HOT segments
or contents that repeat, and neither texts nor candidates of a key meet in one place before they are few.

Segments of more than PIECE strings (periodic texts have them) are cut into pieces, so a candidate is short whatever its text. What is
left of the segments of a very common anchor is cut once more, by a second and finer anchor, so that its contents are
dealt to many tasks.

Index. Candidates of a hash meet in one task. A task takes hashes in bounded chunks and builds for each chunk the
Burrows-Wheeler transform over the suffixes that can begin a match, and keeps its runs: stretches of rows that the same byte
precedes and whose suffixes, extended by it, are neighbours again. A run has its first row, the row to which that leads (an
LF step, the others of the run follow in order), and a sample: the place of the suffix above that row, and how far the two agree.
The suffix array itself is dropped. All strings of a chunk are then streamed through the index together, from their ends to
their beginnings, an LF step for each byte. Within a run the match with the suffix above grows by the byte; at the head of a
run the sample gives the new one. So the matching statistics of all places come from the samples of the runs, and places
with LENGTH or more are marked, as are their partners. Equal candidates in two places are marked whole.

Passages of so many words or more, however short, are found by the same index over texts in which each word stands as WORD
bytes of its hash. There the unit is a word: strings begin at whole words, hashes roll and LF steps go word by word. In plain
texts the unit is a byte. Lengths, anchors and starts are given in bytes, and are whole units.

Equal texts are handled once; a text of LENGTH bytes or more that stands in two rows repeats as a whole.

Defined results: null text counts as empty; texts shorter than LENGTH lose nothing; repeated rows are further places; a
null doc_id stays null; an empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkann.llm.common import documents, key128, shuffle_partitions, text_bytes, unpacked_rows, whole_row, with_row, written

LENGTH, ANCHOR, HOT = 400, 200, 1000
#: Strings of a candidate at most, and the words of a passage: more than 50.
PIECE, PASSAGE = 1024, 51
#: Bytes that stand for a word.
WORD = 6
#: Bytes scanned at a time, and bytes of candidates indexed at a time.
SCAN, CHUNK = 1 << 18, 1 << 19
#: Bytes of candidates that one task gathers, about, and bytes of suffixes copied at a time to sort them.
TASK_BYTES, COPIED = 12 << 20, 32 << 20
MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SEGMENTS = "array<struct<start:long,n:int,anchor:long,hot:boolean>>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def powers(base: int, n: int) -> np.ndarray:
    out, factor = np.ones(1, np.uint64), base
    while len(out) < n:
        out, factor = np.concatenate([out, out * np.uint64(factor)]), factor * factor & MASK
    return out[:n]


class Rolling:
    """Hashes of all strings of a length that begin at a unit, from sums of powers modulo 2^64 that differences cut out."""

    def __init__(self, base: int, unit: int = 1):
        self.base, self.unit = np.uint64(base), unit
        self.up, self.down = powers(base, SCAN + 1), powers(pow(base, -1, 1 << 64), SCAN + 1)
        self.table = self._values(np.arange(256, dtype=np.uint64))

    def _values(self, symbols: np.ndarray) -> np.ndarray:
        return mixed((symbols + np.uint64(1)) * self.base) | np.uint64(1)

    def __call__(self, data: np.ndarray, length: int) -> np.ndarray:
        if self.unit == 1:
            values = self.table[data]
        else:
            symbols = np.zeros((len(data) // self.unit, 8), np.uint8)
            symbols[:, : self.unit] = data.reshape(-1, self.unit)
            values, length = self._values(symbols.view("<u8").ravel()), length // self.unit
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mixed((sums[length:] - sums[:-length]) * self.down[: len(values) - length + 1])


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least (pick: minimum) or greatest of each width values in a row, from those of half as many in each step."""
    done = 1
    while 2 * done <= width:
        values, done = pick(values[:-done], values[done:]), 2 * done
    return pick(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def segments(texts: list[bytes], rolling: Rolling, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, start, number of strings, anchor of each segment, and whether its anchor may stand there twice; long texts in
    parts, which cut a segment at most in two."""
    unit = rolling.unit
    width = (length - anchor) // unit + 1
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def scanned() -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(x for _, _, x in part), np.uint8)
        ends = np.cumsum([len(x) for _, _, x in part]) // unit
        begins = np.r_[0, ends[:-1]]
        hashes = rolling(data, anchor)
        least = sliding(hashes, width, np.minimum)
        # A k-gram is the anchor of some string around it if the greatest of their least hashes is its own. Where a segment
        # holds its anchor twice, nothing else is an anchor between the two.
        around = np.zeros(len(hashes) + width - 1, np.uint64)
        around[width - 1 : width - 1 + len(least)] = least
        chosen = hashes[hashes == sliding(around, width, np.maximum)]
        again = np.unique(chosen[1:][chosen[1:] == chosen[:-1]])
        owner = np.repeat(np.arange(len(part)), ends - begins)[: len(least)]
        valid = np.arange(len(least)) + length // unit <= ends[owner]
        new = valid.copy()
        new[1:] &= (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        stops = np.minimum(np.r_[at[1:], len(least)], ends[owner[at]] - length // unit + 1)
        return np.array([i for i, _, _ in part])[owner[at]], np.array([o for _, o, _ in part])[owner[at]] + (at - begins[owner[at]]) * unit, stops - at, least[at], np.isin(least[at], again) if len(again) else np.zeros(len(at), bool)

    step = SCAN // 2 // unit * unit
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), step):
            piece = text[at : at + step + length - unit]
            if part and size + len(piece) > SCAN:
                yield scanned()
                part, size = [], 0
            part.append((i, at, piece))
            size += len(piece)
    if part:
        yield scanned()


def cut_to_pieces(i: np.ndarray, start: np.ndarray, n: np.ndarray, h: np.ndarray, twice: np.ndarray, unit: int) -> tuple[np.ndarray, ...]:
    """Segments as pieces of PIECE strings at most."""
    times = -(-n // PIECE)
    if times.max(initial=1) == 1:
        return i, start, n, h, twice
    shift = (np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)) * PIECE
    return np.repeat(i, times), np.repeat(start, times) + shift * unit, np.minimum(np.repeat(n, times) - shift, PIECE), np.repeat(h, times), np.repeat(twice, times)


def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch[x].to_numpy(zero_copy_only=False) for x in ("t1", "t2"))


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def anchored(length: int, anchor: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0], unit)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                t1, t2 = keys(part)
                for found in segments(text_bytes(part["text"]), rolling, length, anchor):
                    i, start, n, h, twice = cut_to_pieces(*found, unit)
                    yield batch_of(t1=t1[i], t2=t2[i], start=start.astype(np.int64), n=n.astype(np.int32), anchor=h.view(np.int64), twice=twice)

    return run


def windows(length: int, unit: int):
    """Two hashes of each string of the hot segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (Rolling(b, unit) for b in BASES)
        names = ("t1", "t2", "start", "anchor", "h1", "h2")
        for batch in batches:
            rows: list[tuple] = []
            for t1, t2, text, listed in zip(*(batch[x].to_pylist() for x in ("t1", "t2")), text_bytes(batch["text"]), batch["segments"].to_pylist(), strict=True):
                data = np.frombuffer(text, np.uint8)
                for s in listed:
                    step = SCAN // 2 // unit
                    for done in range(0, s["n"], step):
                        n, at = min(step, s["n"] - done), s["start"] + done * unit
                        own = data[at : at + (n - 1) * unit + length]
                        rows.append((np.full(n, t1), np.full(n, t2), at + unit * np.arange(n), np.full(n, s["anchor"]), first(own, length).view(np.int64), second(own, length).view(np.int64)))
                if sum(len(r[0]) for r in rows) > 50_000:
                    yield batch_of(**{k: np.concatenate(v) for k, v in zip(names, zip(*rows, strict=True), strict=True)})
                    rows = []
            if rows:
                yield batch_of(**{k: np.concatenate(v) for k, v in zip(names, zip(*rows, strict=True), strict=True)})

    return run


def content_keys(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(b"".join(hashlib.md5(x).digest() for x in contents), "<i8").reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def cut_out(batch: pa.RecordBatch, length: int, unit: int) -> Iterator[tuple[int, int, int, list[dict], list[bytes]]]:
    for t1, t2, copies, data, listed in zip(*(batch[x].to_pylist() for x in ("t1", "t2", "copies")), text_bytes(batch["text"]), batch["segments"].to_pylist(), strict=True):
        listed.sort(key=lambda s: s["start"])
        yield t1, t2, copies, listed, [data[s["start"] : s["start"] + (s["n"] - 1) * unit + length] for s in listed]


def places(length: int, unit: int):
    """Where each candidate content stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [(t1, t2, s["start"], s["anchor"], c) for t1, t2, _, listed, found in cut_out(batch.slice(at, 256), length, unit) for s, c in zip(listed, found, strict=True)]
                if own:
                    t1, t2, start, anchor, found = zip(*own, strict=True)
                    c1, c2 = content_keys(found)
                    yield batch_of(t1=np.array(t1), t2=np.array(t2), start=np.array(start, np.int64), anchor=np.array(anchor, np.int64), c1=c1, c2=c2)

    return run


def contents(length: int, unit: int):
    """Each content once with the number of its places in this task; memory is bounded by giving out what has gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            own = [c for _, c in held]
            c1, c2 = content_keys(own)
            return batch_of(anchor=np.array([a for a, _ in held], np.int64), c1=c1, c2=c2, n=np.array(list(held.values()), np.int64), content=pa.array(own, pa.binary()))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for _, _, copies, listed, own in cut_out(batch.slice(at, 256), length, unit):
                    for s, c in zip(listed, own, strict=True):
                        key = (s["anchor"], c)
                        size += len(c) if key not in held else 0
                        held[key] = held.get(key, 0) + copies
                if size > TASK_BYTES:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return run


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of strings, over the suffixes of at least length bytes that begin at a unit."""

    def __init__(self, strings: list[bytes], length: int, unit: int = 1):
        self.length, self.unit = length, unit
        sizes = np.array([len(x) for x in strings], np.int64)
        self.begins = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        self.stops = self.begins + sizes
        self.text = b"\0".join(strings) + b"\0" * 9
        self.words = np.ndarray((len(self.text) - 7,), "<u8", self.text, strides=(1,))
        self.counts = np.maximum((sizes - length) // unit + 1, 0)
        owner = np.repeat(np.arange(len(strings)), self.counts)
        starts = (np.arange(len(owner)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)) * unit + self.begins[owner]
        suffixes, owner = self._sorted(starts, owner)
        row_of = np.full(len(self.text), -1, np.int64)
        row_of[suffixes] = np.arange(len(suffixes))
        # The symbol (a unit) before each suffix, and the row of the suffix that begins there; a string's first has none.
        inside = suffixes > self.begins[owner]
        before = np.where(inside, (self.words[suffixes - unit] & np.uint64((1 << 8 * unit) - 1)).astype(np.int64), -1)
        leads = np.where(inside, row_of[suffixes - unit], -1)
        heads = np.ones(len(suffixes), bool)
        heads[1:] = (before[1:] != before[:-1]) | (leads[1:] != leads[:-1] + 1) | ~inside[1:]
        #: Runs: first row, byte, row to which the first leads; and the sample there.
        self.first = np.flatnonzero(heads)
        self.byte, self.leads = before[self.first], leads[self.first]
        self.above, self.agrees = self._samples(suffixes, owner, self.leads)
        #: The row of each string's last suffix, where its stream begins, with its sample; -1: it has none.
        self.last = np.where(self.counts > 0, row_of[np.maximum(self.stops - length, 0)], -1)
        self.last_above, self.last_agrees = self._samples(suffixes, owner, self.last)

    def _samples(self, suffixes: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the suffix above each row, and how far it agrees with the row's; -1 and 0 if there is none."""
        place, common = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        at = np.flatnonzero(rows > 0)
        below, above = rows[at], rows[at] - 1
        place[at] = suffixes[above]
        common[at] = self._common(suffixes[below], self.stops[owner[below]], suffixes[above], self.stops[owner[above]])
        return place, common

    def _sorted(self, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order: by eight bytes, then those that tie by the rest, equal ones by place. What ties is copied to be
        sorted if it is COPIED bytes at most; else each comparison makes its own copies."""
        key = self.words[starts].byteswap()
        order = np.argsort(key, kind="stable")
        key = key[order]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
        tied = np.flatnonzero(np.diff(edges) > 1)
        text, ends = self.text, self.stops[owner]
        for a, b in zip(edges[tied].tolist(), edges[tied + 1].tolist(), strict=True):
            own = order[a:b]
            places, stops = starts[own], ends[own]
            if int((stops - places).sum()) <= COPIED:
                own = own.tolist()
                rest = {i: text[p + 8 : e] for i, p, e in zip(own, places.tolist(), stops.tolist(), strict=True)}
                own.sort(key=rest.__getitem__)
                order[a:b] = own
            else:
                at = list(zip(places.tolist(), stops.tolist(), own.tolist(), strict=True))
                at.sort(key=cmp_to_key(lambda x, y: -1 if text[x[0] + 8 : x[1]] < text[y[0] + 8 : y[1]] else int(text[x[0] + 8 : x[1]] > text[y[0] + 8 : y[1]])))
                order[a:b] = [i for _, _, i in at]
        return starts[order], owner[order]

    def _common(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of each pair of suffixes, up to the length that counts."""
        most = np.minimum(np.minimum(a_end - a, b_end - b), self.length)
        out = most.copy()
        left = np.arange(len(a))
        done = 0
        while len(left):
            differ = self.words[a[left] + done] ^ self.words[b[left] + done]
            stop = differ != 0
            low = differ[stop] & (~differ[stop] + np.uint64(1))
            out[left[stop]] = done + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            left, done = left[~stop], done + 8
            left = left[most[left] > done]
        return np.minimum(out, most) // self.unit * self.unit

    def matches(self) -> np.ndarray:
        """Whether a match of length bytes with another place begins at each place, from matching statistics streamed over all
        strings, an LF step at a time."""
        found = np.zeros(len(self.text), bool)
        order = np.argsort(-self.counts, kind="stable")
        order = order[self.counts[order] > 0]
        counts, row = self.counts[order], self.last[order]
        place, other, common = self.stops[order] - self.length, self.last_above[order], self.last_agrees[order]
        left = np.searchsorted(-counts, -np.arange(1, counts.max(initial=0) + 2), side="right")  # strings with more places than steps
        for alive in left[1:].tolist():
            long = common >= self.length
            found[place[long]] = True
            found[other[long]] = True
            row, place, other, common = row[:alive], place[:alive] - self.unit, other[:alive] - self.unit, common[:alive] + self.unit
            run = np.searchsorted(self.first, row, side="right") - 1
            into = row - self.first[run]
            row = self.leads[run] + into
            head = np.flatnonzero(into == 0)
            other[head], common[head] = self.above[run[head]], self.agrees[run[head]]
        return found

    def marked(self) -> np.ndarray:
        """For each byte of the text: whether it belongs to a match of length or more with another place."""
        begins = np.flatnonzero(self.matches())
        steps = np.zeros(len(self.text) + 1, np.int64)
        steps[begins] += 1
        steps[begins + self.length] -= 1
        return np.cumsum(steps[:-1]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edges[::2], edges[1::2]


def indexed(length: int, unit: int):
    """Marked runs of each content of the task's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = [b for b in batches if b.num_rows]
        if not gathered:
            return
        table = pa.Table.from_batches(gathered)
        columns = [table[x].to_numpy() for x in ("anchor", "c1", "c2", "n")]
        order = np.lexsort(columns[2::-1])
        anchor, c1, c2, n = (x[order] for x in columns)
        fresh = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])])
        n = np.add.reduceat(n, fresh)
        anchor, c1, c2, order = anchor[fresh], c1[fresh], c2[fresh], order[fresh]
        held = table["content"].take(pa.array(order)).combine_chunks()
        sizes = pc.binary_length(held).to_numpy(zero_copy_only=False)
        groups = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        bounds, begun = [], 0
        for g, h in zip(groups, np.r_[groups[1:], len(anchor)], strict=True):
            if bounds and begun + sizes[g:h].sum() <= CHUNK:
                bounds[-1][1], begun = h, begun + sizes[g:h].sum()
            else:
                bounds.append([g, h])
                begun = sizes[g:h].sum()
        for g, h in bounds:
            index = RunLengthIndex([x.as_py() for x in held[g:h]], length, unit)
            mask = index.marked()
            for i in np.flatnonzero(n[g:h] > 1).tolist():
                mask[index.begins[i] : index.stops[i]] = True
            a, b = runs_of(mask)
            own = np.searchsorted(index.begins, a, side="right") - 1
            at = own + g
            yield batch_of(anchor=anchor[at], c1=c1[at], c2=c2[at], a=(a - index.begins[own]).astype(np.int64), b=(b - index.begins[own]).astype(np.int64))

    return run


def with_keys(docs: DataFrame, *more: Column | str) -> DataFrame:
    key = key128(F.col("text").cast("string"))
    half = lambda i: F.conv(F.hex(F.substring(key, i, 8)), 16, -10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), half(1).alias("t1"), half(9).alias("t2"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def repeats(keyed: DataFrame, texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, unit: int = 1) -> tuple[DataFrame, DataFrame]:
    """keyed: doc_id, t1, t2, text. texts: t1, t2, copies, least (doc_id). Returns texts with candidates (t1, t2, copies, text) and
    their repeated spans (t1, t2, spans), which may overlap."""
    spark = keyed.sparkSession
    found = written(keyed.select("t1", "t2", "text").mapInArrow(anchored(length, anchor, unit), "t1 long, t2 long, start long, n int, anchor long, twice boolean"), "anchors")
    place = F.xxhash64("t1", "t2", "start")
    several = found.groupBy("anchor").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("places"), F.max("twice").alias("twice"))
    several = written(several.where("low <> high or twice").select("anchor", (F.col("places") > hot).alias("hot")), "repeated-anchors")
    listed = found.join(several, "anchor").groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "n", "anchor", "hot")).alias("segments"))
    once = listed.join(texts, ["t1", "t2"]).select(F.col("t1"), F.col("t2"), "copies", F.col("least").alias("doc_id"), "segments")
    held = keyed.alias("k").join(written(once, "listed").alias("o"), F.expr("k.t1 = o.t1 and k.t2 = o.t2 and k.doc_id <=> o.doc_id")).select("o.t1", "o.t2", "o.copies", "k.text", "o.segments")
    held = written(held, "candidates")
    cold = held.withColumn("segments", F.filter("segments", lambda s: ~s["hot"])).where(F.size("segments") > 0)
    if several.where("hot").limit(1).count():
        cold = cold.unionByName(written(trimmed(held.withColumn("segments", F.filter("segments", lambda s: s["hot"])).where(F.size("segments") > 0), length, unit), "trimmed"))
    total = cold.agg(F.sum(F.aggregate("segments", F.lit(0).cast("long"), lambda s, x: s + x["n"] * unit + length))).first()[0] or 0
    given = cold.mapInArrow(contents(length, unit), "anchor long, c1 long, c2 long, n long, content binary")
    marks = given.repartition(shuffle_partitions(spark, total // TASK_BYTES + 1), "anchor").mapInArrow(indexed(length, unit), "anchor long, c1 long, c2 long, a long, b long")
    marks = written(marks, "marks")
    where = cold.select("t1", "t2", "copies", "text", "segments").mapInArrow(places(length, unit), "t1 long, t2 long, start long, anchor long, c1 long, c2 long")
    spans = where.join(marks, ["anchor", "c1", "c2"]).select("t1", "t2", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).alias("span"))
    return held.select("t1", "t2", "copies", "text"), spans.groupBy("t1", "t2").agg(F.collect_set("span").alias("spans"))


def refined(length: int, anchor: int, unit: int):
    """The segments of each text anew, each cut where a finer anchor changes, which depends on a string alone as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[1], unit)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("hot", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = []
                for _, _, _, listed, found in cut_out(part, length, unit):
                    own = []
                    for i, start, n, h, _ in segments(found, rolling, length, anchor):
                        base = np.array([s["start"] for s in listed], np.int64)[i]
                        own += [{"start": a, "n": k, "anchor": x, "hot": True} for a, k, x in zip((base + start).tolist(), n.tolist(), h.view(np.int64).tolist(), strict=True)]
                    lists.append(own)
                yield pa.RecordBatch.from_arrays([part["t1"], part["t2"], part["copies"], part["text"], pa.array(lists, kind)], ["t1", "t2", "copies", "text", "segments"])

    return run


def trimmed(held: DataFrame, length: int, unit: int) -> DataFrame:
    """Segments of very common anchors, cut to the runs of strings whose own hashes stand in two places or more, and these to
    segments of finer anchors."""
    strings = written(held.mapInArrow(windows(length, unit), "t1 long, t2 long, start long, anchor long, h1 long, h2 long"), "windows")
    place = F.xxhash64("t1", "t2", "start")
    several = strings.groupBy("h1", "h2").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    several = written(several.where("low <> high").select("h1", "h2"), "repeated-windows")
    # A run's strings minus their numbers are one value.
    number = F.row_number().over(Window.partitionBy("t1", "t2", "anchor").orderBy("start"))
    kept = strings.join(several, ["h1", "h2"]).select("t1", "t2", "anchor", "start", (F.col("start") - number * unit).alias("run"))
    runs = kept.groupBy("t1", "t2", "anchor", "run").agg(F.min("start").alias("start"), F.count("*").cast("int").alias("n"))
    lists = runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "n", "anchor", F.lit(True).alias("hot"))).alias("segments"))
    found = held.drop("segments").join(written(lists, "trimmed-lists"), ["t1", "t2"]).select("t1", "t2", "copies", "text", "segments")
    return found.mapInArrow(refined(length, length - length // unit // 8 * unit, unit), found.schema)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t1, t2, merged spans and what remains of each text."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [(s := merged(spans), without(text.encode(), s)) for text, spans in zip(part["text"].to_pylist(), part["spans"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["t1"], part["t2"], pa.array([[{"a": a, "b": b} for a, b in s] for s, _ in rows], kind), pa.array([k for _, k in rows], pa.binary())], ["t1", "t2", "spans", "kept"])


def distinct_texts(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "distinct-texts")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, words: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Returns the rows (doc_id, t1, t2, n_bytes, n_words, sha256 of the text), the distinct texts (t1, t2, copies), and, for each text
    that loses anything but has no second copy, t1, t2, spans (merged) and kept (its remaining bytes). Texts with copies of
    length bytes or more are not in the third table: nothing of them remains. The fourth, unless words is 0: what
    repeated_passages() gives."""
    keyed = with_keys(docs)
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = written(keyed.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), n_words.alias("n_words"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256")), "texts")
    texts = distinct_texts(rows)
    held, spans = repeats(keyed, texts, length, anchor, hot)
    kept = held.where("copies = 1").select("t1", "t2", "text").join(written(spans, "spans"), ["t1", "t2"]).mapInArrow(removed, "t1 long, t2 long, spans array<struct<a:long,b:long>>, kept binary")
    return rows, texts.select("t1", "t2", "copies"), kept, repeated_passages(keyed, texts, words) if words else None


def code_of(words: list[bytes]) -> bytes:
    """WORD bytes of the hash of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint8).reshape(-1, 8)[:, :WORD].tobytes()


def coded(words: int):
    """Texts of so many words or more, as WORD bytes for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x.split() for x in text_bytes(part["text"])]
                part = part.filter(pa.array([len(x) >= words for x in texts], pa.bool_()))
                codes = [code_of(x) for x in texts if len(x) >= words]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["t1"], part["t2"], pa.array(codes, pa.binary())], ["doc_id", "t1", "t2", "text"])

    return run


def word_ranges(data: bytes, spans: list[dict] | None, words: int) -> list[dict]:
    """Bytes of the whole words under spans of a coded text."""
    if not spans:
        return []
    at = [m.span() for m in re.finditer(rb"\S+", data)]
    found = ((-(-a // WORD), min(b // WORD, len(at))) for a, b in merged(spans))
    return [{"a": at[i][0], "b": at[j - 1][1]} for i, j in found if j - i >= words]


def passage_counts(words: int):
    """Words under the passages of each text, and maximal runs of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[(-(-a // WORD), b // WORD) for a, b in merged(spans)] for spans in batch["spans"].to_pylist()]
            own = [[j - i for i, j in x if j - i >= words] for x in own]
            yield pa.RecordBatch.from_arrays([batch["t1"], batch["t2"], pa.array([sum(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64())], ["t1", "t2", "words", "passages"])

    return run


def in_words(keyed: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """t1, t2, spans (of the coded text): passages of so many words or more that stand twice, in texts that stand once."""
    return repeats(keyed.mapInArrow(coded(words), "doc_id long, t1 long, t2 long, text binary"), texts, words * WORD, words // 2 * WORD, unit=WORD)[1]


def repeated_passages(keyed: DataFrame, texts: DataFrame, words: int = PASSAGE) -> DataFrame:
    """t1, t2, words (those that a passage of so many words covers which stands twice) and passages (maximal runs of such words) of
    texts that hold any; keyed and texts as for repeats()."""
    return in_words(keyed, texts, words).mapInArrow(passage_counts(words), "t1 long, t2 long, words long, passages long")


def cut_texts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for x, spans, coded_spans in zip(*(part[c].to_pylist() for c in ("text", "spans", "word_spans")), strict=True):
                    if x is not None and (spans or coded_spans):
                        data = x.encode()
                        x = without(data, merged([*(spans or []), *word_ranges(data, coded_spans, words)])).decode("utf-8", "ignore")
                    texts.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part["row"]], ["text", "row"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """docs with repeated spans cut out of text, and with n_chars counted anew if it is there; a character that loses some of
    its bytes goes, a null text stays null. Spans are strings of length bytes and, unless 0, passages of so many words."""
    keyed = with_keys(docs)
    texts = distinct_texts(keyed)
    whole = texts.where("copies > 1").select("t1", "t2", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(MASK >> 1).alias("b"))).alias("spans"))

    def with_copies(spans: DataFrame) -> DataFrame:
        return written(spans.join(whole, ["t1", "t2"], "left_anti").unionByName(whole), "spans")

    found = with_keys(docs, whole_row(docs)).drop("text").join(with_copies(repeats(keyed, texts, length)[1]), ["t1", "t2"], "left")
    if words:
        found = found.join(with_copies(in_words(keyed, texts, words)).withColumnRenamed("spans", "word_spans"), ["t1", "t2"], "left")
    else:
        found = found.withColumn("word_spans", F.lit(None).cast("array<struct<a:long,b:long>>"))
    found = found.withColumn("text", F.col("row")["text"].cast("string"))
    whole_short = F.octet_length("text") < length  # copies of a short text repeat no long string
    found = found.withColumn("spans", F.when(~whole_short, F.col("spans"))).select("row", "text", "spans", "word_spans")
    cut = found.mapInArrow(cut_texts(words), with_row("text string", found))
    return unpacked_rows(cut, text=F.col("text"), n_chars=F.length("text").cast("long"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns at 400 bytes, and beside them what repeated passages of over 50 words cover: n_words, n_passage_words,
    n_passages."""
    rows, texts, kept, passages = remove_repeats(documents(spark, sf_dir), words=PASSAGE)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    digests = kept.select("t1", "t2", n_removed.alias("gone"), F.size("spans").cast("long").alias("parts"), F.sha2("kept", 256).alias("rest"))
    # One table by text, so that rows meet it in a single join, whose hot texts can be split among tasks.
    digests = texts.join(digests, ["t1", "t2"], "left").join(passages, ["t1", "t2"], "left")
    digests = written(digests.where("copies > 1 or gone is not null or words is not null"), "digests")
    copied, by_rule = F.col("copies") > 1, lambda whole, all_of, some: F.when(whole, all_of).otherwise(F.coalesce(F.col(some), F.lit(0))).cast("long")
    whole, whole_words = copied & (F.col("n_bytes") >= LENGTH), copied & (F.col("n_words") >= PASSAGE)
    return rows.join(digests, ["t1", "t2"], "left").select(
        "doc_id",
        "n_bytes",
        by_rule(whole, F.col("n_bytes"), "gone").alias("n_removed"),
        by_rule(whole, F.lit(1), "parts").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("rest", F.lower(F.hex("sha256")))).alias("kept_sha256"),
        "n_words",
        by_rule(whole_words, F.col("n_words"), "words").alias("n_passage_words"),
        by_rule(whole_words, F.lit(1), "passages").alias("n_passages"),
    )


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
SQL = {
    "op3_suffix_dedup": """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT rid, doc_id, octet_length(b)::BIGINT AS n, hex(b) AS x, b FROM d),
w AS (SELECT rid, s, md5(array_slice(b, s + 1, s + 400)) AS k FROM (SELECT rid, b, unnest(range(0, n - 399)) AS s FROM h WHERE n >= 400)),
r AS (SELECT rid, s FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
i AS (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS run FROM (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 400 THEN 0 ELSE 1 END AS fresh FROM r)),
p AS (SELECT rid, run, min(s) AS a, max(s) + 400 AS z FROM i GROUP BY rid, run),
g AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM p),
k AS (SELECT g.rid, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS head, max(z) AS last FROM g JOIN h USING (rid) GROUP BY g.rid),
t AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS t FROM d),
pw AS (SELECT rid, s, md5(array_to_string(list_slice(t, s + 1, s + 51), ' ')) AS k FROM (SELECT rid, t, unnest(range(0, len(t) - 50)) AS s FROM t WHERE len(t) >= 51)),
pr AS (SELECT rid, s FROM pw JOIN (SELECT k FROM pw GROUP BY k HAVING count(*) > 1) USING (k)),
pi AS (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS run FROM (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 51 THEN 0 ELSE 1 END AS fresh FROM pr)),
pk AS (SELECT rid, sum(z - a)::BIGINT AS n_passage_words, count(*) AS n_passages FROM (SELECT rid, min(s) AS a, max(s) + 51 AS z FROM pi GROUP BY rid, run) GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.rid IS NULL THEN x ELSE head || substr(x, (2 * last + 1)::BIGINT) END)) AS kept_sha256,
       len(t.t)::BIGINT AS n_words, coalesce(n_passage_words, 0) AS n_passage_words, coalesce(n_passages, 0) AS n_passages
FROM h LEFT JOIN k USING (rid) JOIN t USING (rid) LEFT JOIN pk USING (rid)"""
}
