"""Merge-type (BPE) piece encoding with seeded merge-dropout, and lossless decoding (operator 7).

A text, with one space before it, is split where no piece of the vocabulary can cross: before each run of spaces that
follows other characters, and around line feeds. Each segment starts as single characters. An agenda gives the candidate
merges, best score first, leftmost among equals. Each candidate that comes up is skipped if a keyed hash of seed, document,
the segment's place, and place and length in it falls below the dropout rate; a skipped candidate is gone, but its parts can still merge with
others. Characters outside the vocabulary become byte pieces. Rate 0 gives the plain segmentation.

So each occurrence of a word is segmented by its own hashes, and the same seed gives the same ids on any cluster. What is remembered
of a segment that has come up twice: the candidates of its agenda when none is skipped, and when a certain one alone is, with
the ids that result. An occurrence hashes these candidates itself; if exactly those are skipped that a remembered agenda skips, its
ids are the remembered ones. All others go through an agenda of their own, whole batches of them in step.

Decoding joins pieces and bytes and drops the first space; it gives back each text exactly, spaces, line feeds, unknown
characters and the space mark U+2581 included.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows get equal ids; a null doc_id
counts as 0 for the hash; an empty table gives an empty result. Columns other than doc_id and text are ignored. Pieces
come from a SentencePiece model file; special pieces are never given out.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkann.llm.common import documents

DROPOUT, SEED = 0.1, 20
MARK = "▁"
#: Agendas remembered by each task, and segments known to have come up; beyond that all are forgotten.
REMEMBERED, SEEN = 600_000, 600_000
#: Segments whose agendas advance together, the longest of them, and the order of a merge that there isn't.
ROWS, WIDEST, NONE = 8192, 48, np.iinfo(np.int32).max
#: Lengths up to which segments advance together.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, WIDEST)
#: Candidates of an agenda whose skipping alone is remembered: as many as a number beside the agenda's has room for.
STEPS = 64
#: Multipliers of the keyed hash (64-bit odd numbers, as in splitmix64).
MIX, STEP, TURN, MASK = 0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15, 0x94D049BB133111EB, (1 << 64) - 1


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.size = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(int(sizes.sum()))


class Pieces:
    """A merge-type vocabulary: encode and decode."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        held = SentencePieceProcessor(model_file=path)
        n = held.get_piece_size()
        self.bytes_of: list[bytes | None] = [None] * n
        self.byte_id, self.id_of, self.rank = [0] * 256, {}, {}
        for i in range(n):
            piece = held.id_to_piece(i)
            if held.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (held.is_control(i) or held.is_unknown(i) or held.is_unused(i)):
                text = piece.replace(MARK, " ")
                self.id_of[text], self.rank[text], self.bytes_of[i] = i, -held.get_score(i), text.encode()
        multi = [x for x in self.id_of if len(x) > 1]
        if any(" " in x.lstrip(" ") or "\n" in x for x in multi):
            raise ValueError(f"{path}: pieces cross words; texts cannot be split there")
        self.segments = re.compile(r"\n| +[^ \n]*|[^ \n]+").findall
        self._forget()
        self._learn_pairs()

    def _forget(self) -> None:
        """Remembered agendas: of segments (none skipped), and of an agenda's number and a step (that one alone skipped); the hashed
        parts of the candidates of each, its ids, and where they begin."""
        self.number: dict[str, int] = {}
        self.single: dict[int, int] = {}
        self.seen: set[str] = set()
        self.tries, self.try_begins, self.ids, self.id_begins = Growing(np.uint64), Growing(np.int64), Growing(np.int32), Growing(np.int64)
        self.try_begins.add(np.zeros(1, np.int64))
        self.id_begins.add(np.zeros(1, np.int64))

    def _learn_pairs(self) -> None:
        """A table of merges for whole batches. Symbols are numbers: pieces, then characters that only stand within pieces, then
        one for any other. A pair of symbols is looked up by open addressing: few steps, as most places are free."""
        n = len(self.bytes_of)
        inner = sorted({c for x in self.id_of for c in x} - set(self.id_of))
        self.symbol = self.id_of | {c: n + i for i, c in enumerate(inner)}
        self.other = n + len(inner)
        if self.other >= 1 << 20:
            raise ValueError(f"{self.other} symbols: pairs are numbered for 2^20 at most")
        self.char_symbol = np.full(0x110000, self.other, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.char_symbol[ord(c)] = i
        order = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}  # pieces of one score come up by place
        self.turns = np.array([len(t) if t is not None else 0 for t in self._texts()], np.uint64) * np.uint64(TURN)
        pairs = {}
        for text, i in self.id_of.items():
            for cut in range(1, len(text)):
                a, b = self.symbol.get(text[:cut]), self.symbol.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = order[self.rank[text]], i
        size = 1 << (4 * len(pairs)).bit_length()
        self.pair_keys, self.pair_orders, self.pair_mask = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), size - 1
        self.pair_made = np.zeros(size, np.int32)
        for key, (value, made) in pairs.items():
            at = int(self._slot(np.array([key]))[0])
            while self.pair_keys[at] >= 0:
                at = at + 1 & self.pair_mask
            self.pair_keys[at], self.pair_orders[at], self.pair_made[at] = key, value, made

    def _texts(self) -> list[str | None]:
        out: list[str | None] = [None] * len(self.bytes_of)
        for t, i in self.id_of.items():
            out[i] = t
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(STEP)) >> np.uint64(40)).astype(np.int64) & self.pair_mask

    def _merges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of merging of pairs of symbols, NONE where they don't merge, and the piece that they make."""
        keys = a << 20 | b
        at = self._slot(keys)
        held = self.pair_keys[at]
        wrong = np.flatnonzero((held != keys) & (held >= 0))
        while len(wrong):
            at[wrong] = at[wrong] + 1 & self.pair_mask
            held = self.pair_keys[at[wrong]]
            wrong = wrong[(held != keys[wrong]) & (held >= 0)]
        return self.pair_orders[at], self.pair_made[at]  # NONE where the search ended at a free place

    def segment_flat(self, texts: list[str], keys: np.ndarray, rate: float, tried: bool = False) -> tuple[np.ndarray, ...]:
        """Ids of many segments, as segment() gives them, in one array, with where those of each begin and how many they are: agendas of
        segments up to WIDEST advance together, one candidate each at a time. With tried also the hashed parts of the candidates
        that came up for each such segment, in one array, whether each was skipped, where they begin and how many they are."""
        n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        kind = np.searchsorted(WIDTHS, sizes)
        flat, begin, count, at = [], np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        tries, gone, first, many, tried_at = [], [], np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for k, width in enumerate(WIDTHS):
            of_kind = np.flatnonzero(kind == k)
            for a in range(0, len(of_kind), ROWS):
                own = of_kind[a : a + ROWS]
                steps: list[tuple[np.ndarray, ...]] = []
                ids, each = self._advance([texts[i] for i in own.tolist()], sizes[own], keys[own], rate, width, steps if tried else None)
                flat.append(ids)
                count[own], begin[own] = each, at + np.cumsum(each) - each
                at += len(ids)
                if tried:
                    rows, values, skipped = (np.concatenate(x) for x in zip(*steps, strict=True))
                    order = np.argsort(rows, kind="stable")
                    tries.append(values[order])
                    gone.append(skipped[order])
                    many[own] = each = np.bincount(rows, minlength=len(own))
                    first[own] = tried_at + np.cumsum(each) - each
                    tried_at += len(rows)
        for i in np.flatnonzero(sizes > WIDEST).tolist():
            ids = np.array(self.segment(texts[i], int(keys[i]), rate), np.int32)
            flat.append(ids)
            begin[i], count[i], at = at, len(ids), at + len(ids)
        found = (np.concatenate([np.zeros(0, np.int32), *flat]), begin, count)
        return (*found, np.concatenate([np.zeros(0, np.uint64), *tries]), np.concatenate([np.zeros(0, bool), *gone]), first, many) if tried else found

    def segment_many(self, texts: list[str], keys: list[int], rate: float) -> list[list[int]]:
        flat, begin, count = self.segment_flat(texts, np.array(keys, np.uint64), rate)
        return [flat[a : a + n].tolist() for a, n in zip(begin.tolist(), count.tolist(), strict=True)]

    def _advance(self, texts: list[str], sizes: np.ndarray, keys: np.ndarray, rate: float, width: int, steps: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """One block of segments. Symbols stay at the place of their first character; before and after name those alive, in flat
        places, where the last of a row is a border."""
        n, wide = len(texts), width + 1
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = np.full(n * wide, -1, np.int64)
        at = ranges(np.arange(n) * wide, sizes)
        symbols[at] = self.char_symbol[chars]
        after, before = np.arange(1, n * wide + 1), np.arange(-1, n * wide - 1)
        agenda, makes = np.full(n * wide, NONE, np.int32), np.zeros(n * wide, np.int32)  # of each symbol's merge with the next
        pair = at[symbols[np.minimum(at + 1, n * wide - 1)] >= 0]
        agenda[pair], makes[pair] = self._merges(symbols[pair], symbols[pair + 1])
        limit, rows, table = np.uint64(int(rate * (1 << 32))), np.arange(n), agenda.reshape(n, wide)
        while len(rows):
            best = table[rows].argmin(axis=1) if len(rows) < n else table.argmin(axis=1)  # the leftmost among equals
            i = rows * wide + best
            alive = agenda[i] < NONE
            rows, best, i = rows[alive], best[alive], i[alive]
            made = makes[i].astype(np.int64)
            part = best.astype(np.uint64) * np.uint64(STEP) + self.turns[made]
            skipped = (((keys[rows] ^ part) * np.uint64(MIX)) >> np.uint64(32)) < limit
            if steps is not None:
                steps.append((rows, part, skipped))
            if limit:
                agenda[i[skipped]] = NONE
                i, made = i[~skipped], made[~skipped]
            j = after[i]
            k = after[j]
            symbols[i], symbols[j], agenda[j], after[i] = made, -1, NONE, k
            last = symbols[np.minimum(k, n * wide - 1)] < 0
            agenda[i[last]] = NONE
            i_, k_, made_ = i[~last], k[~last], made[~last]
            before[k_] = i_
            agenda[i_], makes[i_] = self._merges(made_, symbols[k_])
            h = before[i]
            there = (h >= 0) & (symbols[h] >= 0)
            h, made = h[there], made[there]
            agenda[h], makes[h] = self._merges(symbols[h], made)
        kept = np.flatnonzero(symbols >= 0)
        held, row = symbols[kept], kept // wide
        bare = np.flatnonzero(held >= len(self.bytes_of))  # characters that are no pieces: bytes
        if len(bare):
            spelt = [self._out(texts[r][p]) for r, p in zip(row[bare].tolist(), (kept[bare] % wide).tolist(), strict=True)]
            times = np.ones(len(held), np.int64)
            times[bare] = [len(x) for x in spelt]
            held, row = np.repeat(held, times), np.repeat(row, times)
            held[ranges((np.cumsum(times) - times)[bare], times[bare])] = list(chain.from_iterable(spelt))
        return held.astype(np.int32), np.bincount(row, minlength=n)

    def _out(self, symbol: str) -> list[int]:
        i = self.id_of.get(symbol)
        return [i] if i is not None else [self.byte_id[b] for b in symbol.encode()]

    def segment(self, text: str, key: int, rate: float) -> list[int]:
        """Ids of one segment; key: its keyed hash."""
        symbols: list[str] = list(text)
        n = len(symbols)
        if n == 1:
            return self._out(text)
        rank = self.rank.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            r = rank(both := symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append((r, i, i + 1, both))
        heapq.heapify(agenda)
        limit = int(rate * (1 << 32))
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if after[i] != j or symbols[i] + symbols[j] != both or not symbols[i]:
                continue  # one of its parts has merged with another
            if limit and ((((key ^ (i * STEP + len(both) * TURN)) * MIX) & MASK) >> 32) < limit:
                continue
            symbols[i], symbols[j] = both, ""
            k = after[i] = after[j]
            after[j] = -2
            if k >= 0:
                before[k] = i
                r = rank(more := both + symbols[k])
                if r is not None:
                    heapq.heappush(agenda, (r, i, k, more))
            h = before[i]
            if h >= 0:
                r = rank(more := symbols[h] + both)
                if r is not None:
                    heapq.heappush(agenda, (r, h, i, more))
        out: list[int] = []
        i = 0
        while i >= 0:
            out += self._out(symbols[i])
            i = after[i]
        return out

    def parts(self, text: str, doc_id: int | None, seed: int) -> tuple[list[str], np.ndarray]:
        """Segments of a text, and the keyed hash of each occurrence."""
        parts = self.segments(" " + text) if text else []
        base = xxhash.xxh64_intdigest(f"{seed}:{doc_id or 0}".encode())
        places = np.arange(len(parts), dtype=np.uint64) * np.uint64(STEP) + np.uint64(base)
        places = (places ^ (places >> np.uint64(31))) * np.uint64(MIX)
        places = (places ^ (places >> np.uint64(29))) * np.uint64(TURN)
        return parts, places ^ (places >> np.uint64(32))

    def _remember(self, found: tuple[np.ndarray, ...], which: np.ndarray) -> int:
        """Keep agendas of what segment_flat() has found; returns the number of the first."""
        flat, begin, count, tries, _, first, many = found
        at = self.id_begins.size - 1
        self.ids.add(flat[ranges(begin[which], count[which])])
        self.id_begins.add(self.id_begins.held[at] + np.cumsum(count[which]))
        self.tries.add(tries[ranges(first[which], many[which])])
        self.try_begins.add(self.try_begins.held[at] + np.cumsum(many[which]))
        return at

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The remembered agenda of each segment without a skip, -1: none. Segments that come up for the second time are learnt."""
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            counts = Counter([words[i] for i in unknown.tolist()])
            fresh = [w for w, c in counts.items() if (c > 1 or w in self.seen) and len(w) <= WIDEST]
            self.seen.update(w for w, c in counts.items() if c == 1 and len(w) <= WIDEST)
            if fresh:
                found = self.segment_flat(fresh, np.zeros(len(fresh), np.uint64), 0.0, True)
                at = self._remember(found, np.arange(len(fresh)))
                self.number.update(zip(fresh, range(at, at + len(fresh)), strict=True))
                number[unknown] = np.fromiter((self.number.get(words[i], -1) for i in unknown.tolist()), np.int64, len(unknown))
        return number

    def _skips(self, number: np.ndarray, keys: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """How many candidates of the remembered agendas the keys skip, and which step is the first of them."""
        begins = self.try_begins.held[number]
        many = self.try_begins.held[number + 1] - begins
        hashed = np.repeat(keys, many) ^ self.tries.held[ranges(begins, many)]
        skipped = np.flatnonzero(((hashed * np.uint64(MIX)) >> np.uint64(32)) < limit)
        ends = np.cumsum(many)
        row = np.searchsorted(ends, skipped, side="right")
        times, first = np.bincount(row, minlength=len(number)), np.full(len(number), -1, np.int64)
        begun = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
        first[row[begun]] = skipped[begun] - (ends - many)[row[begun]]
        return times, first

    def encode_flat(self, texts: list[str], doc_ids: list[int | None], rate: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where those of each end."""
        if self.id_begins.size > REMEMBERED or len(self.seen) > SEEN:
            self._forget()
        parts = [self.parts(t, d, seed) for t, d in zip(texts, doc_ids, strict=True)]
        words = list(chain.from_iterable(own for own, _ in parts))
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for _, k in parts)])
        limit = np.uint64(int(rate * (1 << 32)))
        number = self._numbers(words)
        agenda = number.copy()  # the remembered agenda that an occurrence follows, -1: its own
        known = np.flatnonzero(number >= 0)
        times, first = self._skips(number[known], keys[known], limit)
        at, step = known[times > 0], first[times > 0]
        pair = np.where(step < STEPS, number[at] * STEPS + step, -1)
        agenda[at] = np.fromiter(map(self.single.get, pair.tolist(), repeat(-1)), np.int64, len(at))
        again = at[agenda[at] >= 0]
        agenda[again[self._skips(agenda[again], keys[again], limit)[0] > 1]] = -1
        own = np.flatnonzero(agenda < 0)
        found = self.segment_flat([words[i] for i in own.tolist()], keys[own], rate, True)
        self._learn_single(number[own], found)
        flat, begin, count = found[:3]
        sizes = np.zeros(len(words), np.int64)
        sizes[own] = count
        held = np.flatnonzero(agenda >= 0)
        sizes[held] = self.id_begins.held[agenda[held] + 1] - self.id_begins.held[agenda[held]]
        ends = np.cumsum(sizes)
        out = np.empty(int(sizes.sum()), np.int32)
        out[ranges((ends - sizes)[own], count)] = flat[ranges(begin, count)]
        out[ranges((ends - sizes)[held], sizes[held])] = self.ids.held[ranges(self.id_begins.held[agenda[held]], sizes[held])]
        stops = np.cumsum([len(p) for p, _ in parts])
        return out, np.r_[0, ends][stops]

    def _learn_single(self, number: np.ndarray, found: tuple[np.ndarray, ...]) -> None:
        """Remember agendas of known segments that skipped one candidate alone."""
        _, _, _, _, gone, first, many = found
        skipped = np.flatnonzero(gone)
        order = np.argsort(first, kind="stable")
        order = order[many[order] > 0]
        row = order[np.searchsorted(first[order], skipped, side="right") - 1]
        times, step = np.bincount(row, minlength=len(number)), np.zeros(len(number), np.int64)
        step[row] = skipped - first[row]
        new = np.flatnonzero((number >= 0) & (times == 1) & (step < STEPS))
        pairs, once = np.unique(number[new] * STEPS + step[new], return_index=True)
        fresh = np.fromiter((p not in self.single for p in pairs.tolist()), bool, len(pairs))
        at = self._remember(found, new[once[fresh]])
        self.single.update(zip(pairs[fresh].tolist(), range(at, at + int(fresh.sum())), strict=True))

    def encode_many(self, texts: list[str], doc_ids: list[int | None], rate: float = DROPOUT, seed: int = SEED) -> list[list[int]]:
        flat, ends = self.encode_flat(texts, doc_ids, rate, seed)
        return [x.tolist() for x in np.split(flat, ends[:-1])] if len(texts) else []

    def encode(self, text: str, doc_id: int | None = 0, rate: float = DROPOUT, seed: int = SEED) -> list[int]:
        return self.encode_many([text], [doc_id], rate, seed)[0]

    def decode(self, ids: list[int]) -> str:
        held = self.bytes_of
        return b"".join([held[i] for i in ids]).decode()[1:] if len(ids) else ""


def encoding(path: str, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values, ends = pieces.encode_flat([x or "" for x in part["text"].to_pylist()], part["doc_id"].to_pylist(), rate, seed)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["md5"], ids], ["doc_id", "md5", "ids"])

    return run


def decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x.values.to_numpy(zero_copy_only=False) for x in part["ids"]]
                texts = [pieces.decode(x.tolist()) for x in ids]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["md5"], pa.array(texts, pa.string()), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "md5", "text", "n_ids", "ids_crc32"])

    return run


def encode(docs: DataFrame, path: str, rate: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, md5 (of the text, for checks) and ids of each document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.withColumn("md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return slim.mapInArrow(encoding(path, rate, seed), "doc_id long, md5 string, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, md5 as it came, text, n_ids and ids_crc32 (little-endian unsigned 32-bit ids)."""
    return encoded.mapInArrow(decoding(path), "doc_id long, md5 string, text string, n_ids long, ids_crc32 long")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_bytes, decoded_md5 and lossless (the decoded text is the document's)."""
    out = decode(encode(documents(spark, sf_dir), default_model()), default_model())
    decoded = F.md5(F.col("text").cast("binary"))
    return out.select("doc_id", "n_ids", "ids_crc32", F.octet_length("text").cast("long").alias("decoded_bytes"), decoded.alias("decoded_md5"), (decoded == F.col("md5")).alias("lossless"))


QUERIES = {"op7_merge_dropout": op7_merge_dropout}
SQL: dict[str, str] = {}
