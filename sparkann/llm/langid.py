"""Language spans of mixed-language text: script ranges, per-word scores and Viterbi (operator 5).

Training counts character n-grams (one to four, with word borders) of a bounded sample: about PER_LANGUAGE documents of
each language, chosen by a hash of the row, the same for any partitioning. N-grams are hashed to BUCKETS counts for each
language, so the model's size is bounded by the number of languages. The share of each script among a language's words
is learned too.

To label a text, each whitespace word gets a log-probability per language. The script of most of its letters, found from
Unicode ranges, narrows the candidates to languages that use that script; if there are none, all stay. Viterbi then finds
the best sequence of languages, where each change costs PENALTY nats; its runs are the spans. The document's language is
the one with most letters, its score the share of letters it has.

Defined results: a null text, or one without letters, is "und" with score 0 and no spans; null or empty labels train
nothing; without any label all texts are "und"; ties go to the language that sorts first; repeated rows count as often as
they stand there; an empty table gives an empty result. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkann.llm.common import documents

PER_LANGUAGE = 4000
BITS, GRAMS, PENALTY = 15, 4, 6.0
BUCKETS = 1 << BITS
#: Words remembered with their scores by each task.
REMEMBERED = 200_000
#: First code points of blocks, from Unicode; a block lasts to the next entry. Fixed values.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"), (0x0E80, "lao"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
STARTS = [a for a, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})
NUMBERS = np.array([NAMES.index(n) for _, n in SCRIPTS])
#: Words scored at a time, and multipliers of the n-gram hash.
CHUNK, FACTOR, MIX = 20_000, np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: A language is a candidate for a script that at least this share of its training words has.
LEAST_SHARE = 0.01
LETTER = re.compile(r"[^\W\d_]")
OUT = "doc_id long, lang_pred string, score double, spans array<struct<first_word:int,last_word:int,lang:string>>"


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(LETTER.findall(word))


def scripts_of(words: list[str]) -> np.ndarray:
    """Number of the script that most letters of each word have; ties to the first name."""
    out = np.full(len(words), NAMES.index("latin"))
    other = [i for i, w in enumerate(words) if not w.isascii()]
    if other:
        points = np.frombuffer("".join(words[i] for i in other).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(other)), [len(words[i]) for i in other])
        script = NUMBERS[np.searchsorted(STARTS, points, side="right") - 1]
        out[other] = np.bincount(owner * len(NAMES) + script, minlength=len(other) * len(NAMES)).reshape(-1, len(NAMES)).argmax(axis=1)
    return out


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word and bucket of each hashed n-gram of many words (letters only, any case) at once."""
    held = [f" {w.lower()} " for w in words]
    points = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    owner = np.repeat(np.arange(len(held)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters to the word's end, this one included
    hashed, owners, buckets = np.zeros(len(points), np.uint64), [], []
    for n in range(1, GRAMS + 1):
        hashed[: len(points) - n + 1] = hashed[: len(points) - n + 1] * FACTOR + points[n - 1 :]
        at = np.flatnonzero((left >= n) & (points != 32) if n == 1 else left >= n)
        owners.append(owner[at])
        buckets.append((((hashed[at] + np.uint64(n)) * MIX) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n; scripts have buckets from BUCKETS on."""
    words: dict[str, Counter] = defaultdict(Counter)
    totals: dict[str, np.ndarray] = {}

    def fold() -> None:
        for lang, found in words.items():
            total = totals.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
            held = [(x, n) for w, n in found.items() if (x := letters_of(w))]
            for at in range(0, len(held), CHUNK):
                own, times = [x for x, _ in held[at : at + CHUNK]], np.array([n for _, n in held[at : at + CHUNK]], float)
                owner, bucket = grams_of(own)
                total[:BUCKETS] += np.bincount(bucket, times[owner], BUCKETS)
                total[BUCKETS:] += np.bincount(scripts_of(own), times, len(NAMES))
        words.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words[lang].update(text.split())
            if sum(map(len, words.values())) > REMEMBERED:
                fold()
    fold()
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["lang", "bucket", "n"])


class Model:
    """Learned languages (sorted), log-probabilities (bucket, language) and candidates (script, language)."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.languages = sorted(counts)
        n = np.zeros((BUCKETS + len(NAMES), len(self.languages)))
        for i, lang in enumerate(self.languages):
            n[list(counts[lang]), i] = list(counts[lang].values())
        grams, scripts = n[:BUCKETS] + 0.5, n[BUCKETS:]
        self.scores = np.log(grams / grams.sum(axis=0)).astype(np.float32)
        allowed = scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=0), 1)
        allowed &= scripts > 0
        allowed[~allowed.any(axis=1)] = True
        self.barred = np.where(allowed, 0, -1e4).astype(np.float32)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """docs: text, lang. The sample is bounded in expectation by per_language documents of each language."""
    held = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("doc_id")).where("text is not null and lang is not null and lang <> ''")
    sizes = {r[0]: r[1] for r in held.groupBy("lang").count().collect()}  # one row per language
    rates = held.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sizes.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = held.join(F.broadcast(rates), "lang").where(draw < F.col("rate"))
    counts: dict[str, dict[int, int]] = {}
    for r in sample.select("lang", "text").mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r[0], {})[r[1]] = r[2]  # BUCKETS + scripts for each language at most
    return Model(counts)


class Scorer:
    """Per-word scores; scores of recent words are remembered."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.table = np.zeros((REMEMBERED, len(model.languages)), np.float32)
        self.letters = np.zeros(REMEMBERED, np.int32)

    def _learn(self, fresh: list[str]) -> None:
        """Score words not seen so far, many at once."""
        base = len(self.index)
        while base + len(fresh) > len(self.table):  # a batch may have more words than are remembered
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        for at in range(0, len(fresh), CHUNK):
            own = [letters_of(w) for w in fresh[at : at + CHUNK]]
            rows = slice(base + at, base + at + len(own))
            self.letters[rows] = [len(w) for w in own]
            owner, bucket = grams_of(own)
            scores = self.model.scores[bucket]
            sums = np.stack([np.bincount(owner, scores[:, i], len(own)) for i in range(scores.shape[1])], axis=1)
            sums += self.model.barred[scripts_of(own)]
            sums[self.letters[rows] == 0] = 0  # a word without letters says nothing
            self.table[rows] = sums
        self.index.update(zip(fresh, range(base, base + len(fresh)), strict=True))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (word, language) and letters of each word."""
        if len(self.index) >= REMEMBERED:
            self.index.clear()
        known = self.index
        self._learn(list({w: None for w in words if w not in known}))
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return self.table[at], self.letters[at]


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word. Texts, longest first, lie one after another in scores; all advance together."""
    n, languages = scores.shape
    came = np.zeros((n, languages), np.int16)
    own = np.arange(languages, dtype=np.int16)
    value = scores[starts].astype(np.float64)
    alive = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right") if len(lengths) else []
    for t in range(1, int(lengths[0]) if len(lengths) else 0):
        k = int(alive[t])
        at, v = starts[:k] + t, value[:k]
        best = v.argmax(axis=1)
        changed = (v[np.arange(k), best] - penalty)[:, None]
        change = changed > v
        came[at] = np.where(change, best[:, None].astype(np.int16), own)
        value[:k] = np.where(change, changed, v) + scores[at]
    labels = np.zeros(n, np.int16)
    now = value.argmax(axis=1).astype(np.int16)
    for t in range(int(lengths[0]) - 1 if len(lengths) else -1, -1, -1):
        k = int(alive[t])
        at = starts[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = came[at, now[:k]]
    return labels


def spans_of(labels: np.ndarray, languages: list[str]) -> list[dict]:
    cuts = np.r_[0, np.flatnonzero(labels[1:] != labels[:-1]) + 1, len(labels)]
    return [{"first_word": int(a), "last_word": int(b) - 1, "lang": languages[labels[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]


def label(texts: list[str | None], score: Scorer) -> list[tuple[str, float, list[dict]]]:
    """lang_pred, score and spans of each text."""
    languages = score.model.languages
    words = [x.split() if x else [] for x in texts]
    out: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(texts)
    order = sorted((i for i, w in enumerate(words) if w), key=lambda i: -len(words[i]))
    if not languages or not order:
        return out
    lengths = np.array([len(words[i]) for i in order], np.int64)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    scores, letters = score([w for i in order for w in words[i]])
    labels = viterbi(scores, starts, lengths)
    for i, a, n in zip(order, starts.tolist(), lengths.tolist(), strict=True):
        had = np.bincount(labels[a : a + n], weights=letters[a : a + n], minlength=len(languages))
        if had.sum():
            best = int(had.argmax())
            out[i] = (languages[best], float(had[best] / had.sum()), spans_of(labels[a : a + n], languages))
    return out


def labelled(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = label(part["text"].to_pylist(), score)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), kind)))], ["doc_id", "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans (numbers of whitespace words) of each document, from its text alone."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(labelled(model), OUT)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
