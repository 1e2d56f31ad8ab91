"""Quality rules with risk-controlled thresholds (operator 9).

Every document gets word, symbol, line and repetition counts. A rule is a badness metric with a grid of cutoffs. Labelled
holdout texts of good quality say how often cutoffs would reject good texts; each text counts once, however many copies it has.

A stratum (language) has one path of joint cutoffs of all rules, from the mildest to the strictest. A fifth of the labelled
texts, told by a hash of the text, draws the path and is used for nothing else: first margins above the mildest cutoffs that
reject none of its good texts, then what the best trade is at a falling price of a good text in bad ones. The other four fifths
test the path's steps one after another: a step is certified when P(Bin(n, alpha) <= k) <= delta of the stratum, by the exact
binomial tail, n good texts, k of them rejected by any rule. Testing stops at the first step that fails (fixed-sequence
testing needs no correction along a path). Each stratum begins with delta / strata; one whose whole path is certified passes
its share on to the others, which are tested again (a graphical Holm procedure). So with confidence 1 - delta no stratum loses
more than alpha of its good texts to the certified steps, and as that holds for all of them at once, the one with the
most gain is used: rejected bad texts less PRICE times the good ones, ties to the mildest; without gain no rule is on.

Defined results: null or blank text has no words and fails the base rule; a null language is the stratum "?"; documents
without label take part in nothing but the verdict; a document, or a text, with labels that disagree counts as good; null
labels are no labels; repeated rows are judged one by one; without enough labels no cutoff is certified and only
the base rule rejects; an empty table gives an empty result. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkann.llm.common import documents, key128, text_bytes, unpacked_rows, whole_row, with_row, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: rule: bins of the metric per unit. Larger is worse; metrics are fractions from 0 to 1, cut off at 1.
RULES = {"symbols": 50, "dup_lines": 50, "repeats": 50, "capitals": 50, "marks": 50, "rare_vocabulary": 50}
ALPHA, DELTA, PRICE = 0.02, 0.05, 20
#: One in so many labelled texts draws the paths; margins of the first steps, and prices of a good text of the later ones.
TUNING, MARGINS, PRICES = 5, (0.75, 0.5, 0.25, 0.0), (50, 20, 10, 5, 2, 1)
FEATURES = "doc_id long, stratum string, key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, metrics array<double>"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n - 2:
        return 0
    ids: dict = {}
    index = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, n - 2)
    hit = np.bincount(index)[index] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' metrics of one text."""
    words = text.split()
    n = len(words)
    string = text.decode("utf-8", "replace")
    word_chars = len(string) - sum(map(string.count, SPACES))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else [text] if n else []
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(text) - len(text.translate(None, b"!?~^_=+{}[]\\@/"))
    share = lambda x, of: min(1.0, x / of) if of else 0.0
    metrics = [share(n_symbols, n * 2), share(n_dup, len(lines)), share(n_repeat, n), share(upper, word_chars), share(marks, n * 2), 1 - share(len(set(words)), n) if n else 0.0]
    return n, word_chars, n_symbols, n_dup, n_repeat, metrics


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [measure(x) for x in text_bytes(part["text"])]
            carried = [part["row"]] if "row" in part.schema.names else []
            columns = [part["doc_id"], part["stratum"], part["key"], *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5)), pa.array([r[5] for r in rows], pa.list_(pa.float64())), *carried]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "stratum", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "metrics", "row"][: len(columns)])


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per document: counts, base verdict, the bin of each rule's metric and a key of its text; with carry, all its columns in row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("stratum"), F.col("text").cast("string").alias("text"), key128(F.col("text").cast("string")).alias("key"), *[whole_row(docs)] * carry)
    bins = F.array(*(F.floor(F.col("metrics")[i] * n).cast("int") for i, n in enumerate(RULES.values())))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return slim.mapInArrow(measured, with_row(FEATURES, slim) if carry else FEATURES).withColumns({"base_failed": failed, "bins": bins}).drop("metrics")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly in logarithms from the largest term down."""
    if k >= n:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(min(k, int(n * p)), -1, -1)]
    if k > n * p:  # beyond the mean no cutoff can pass
        return 1.0
    top = max(terms)
    return exp(top) * sum(exp(t - top) for t in terms)


def path(good: list[dict[int, int]], bad: list[dict[int, int]]) -> list[list[int]]:
    """Joint cutoffs (the bin from which on each rule rejects) step by step, each at least as strict as the one before; good, bad:
    tuning texts by bin, for each rule. A rule that is off has a cutoff beyond its last bin."""

    def best(rule: int, bins: int, price: float) -> int:
        found, most, g, b = bins + 1, 0.0, 0, 0
        for cutoff in range(bins, 0, -1):
            g, b = g + good[rule].get(cutoff, 0), b + bad[rule].get(cutoff, 0)
            if b and (gain := b - price * g if g else b) > most:
                found, most = cutoff, gain
        return found

    rules = list(enumerate(RULES.values()))
    safe = [best(i, n, float("inf")) for i, n in rules]
    steps = [[c + int(np.ceil((n + 1 - c) * margin)) for c, (_, n) in zip(safe, rules, strict=True)] for margin in MARGINS]
    for price in PRICES:
        steps.append([min(c, best(i, n, price)) for c, (i, n) in zip(steps[-1], rules, strict=True)])
    off = [n + 1 for _, n in rules]
    return [s for i, s in enumerate(steps) if s != (steps[i - 1] if i else off)]


def paths(pdf: pd.DataFrame) -> pd.DataFrame:
    """The path of one stratum from its histogram (rule, bin, good, bad), which has at most as many rows as grid points."""
    split = [pdf[pdf["rule"] == i] for i in range(len(RULES))]
    good, bad = ([dict(zip(own["bin"], own[x], strict=True)) for own in split] for x in ("good", "bad"))
    rows = [(pdf["stratum"].iloc[0], step, rule, cutoff) for step, cutoffs in enumerate(path(good, bad)) for rule, cutoff in enumerate(cutoffs)]
    return pd.DataFrame(rows, columns=["stratum", "step", "rule", "cutoff"])


def certified(rejected: dict[str, list[int]], n: dict[str, int], alpha: float, delta: float) -> dict[str, int]:
    """How many steps of each stratum's path are certified; rejected: its good texts that each step rejects, n: all of them."""
    share = {s: delta / len(rejected) for s in rejected}
    passed = dict.fromkeys(rejected, 0)
    while share:
        for s, level in share.items():
            while passed[s] < len(rejected[s]) and binomial_tail(rejected[s][passed[s]], n[s], alpha) <= level:
                passed[s] += 1
        whole = [s for s in share if passed[s] == len(rejected[s])]
        free = sum(share.pop(s) for s in whole)
        if not whole:
            break
        share = {s: level + free / len(share) for s, level in share.items()}
    return passed


def thresholds(spark: SparkSession, measured_docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, name, cutoff and n_good of the rules that are on, from all labelled texts that pass the base rule."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    label = label.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = measured_docs.where(~F.col("base_failed")).select("doc_id", "stratum", "key", "bins").join(label, "doc_id")
    once = held.groupBy("stratum", "key").agg(F.max("quality").alias("quality"), F.min("bins").alias("bins"))
    once = written(once.withColumn("tuning", F.crc32("key") % TUNING == 0).drop("key"), "quality-holdout")
    good, bad = F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    bins = once.where("tuning").select("stratum", "quality", F.posexplode("bins").alias("rule", "bin"))
    drawn = bins.groupBy("stratum", "rule", "bin").agg(good, bad).groupBy("stratum").applyInPandas(paths, "stratum string, step int, rule int, cutoff int")
    drawn = written(drawn, "quality-paths")
    steps = drawn.groupBy("stratum").agg(F.collect_list(F.struct("step", "rule", "cutoff")).alias("path"))
    # A text's first step is the mildest that rejects it; stricter ones do as well.
    rejecting = F.filter("path", lambda c: F.get(F.col("bins"), c["rule"]) >= c["cutoff"])
    tested = once.where("not tuning").join(steps, "stratum").withColumn("first", F.array_min(F.transform(rejecting, lambda c: c["step"])))
    counts = tested.groupBy("stratum", "first").agg(good, bad)
    # A stratum with fewer good texts cannot be certified whatever they say, so as many rows as labels / enough come here.
    enough = log(delta) / log1p(-alpha)
    sums = counts.groupBy("stratum").agg(F.sum("good").alias("n"), F.collect_list(F.struct("first", "good", "bad")).alias("counts")).where(F.col("n") >= enough)
    found = {r["stratum"]: r for r in sums.collect()}
    n_steps = {r[0]: r[1] + 1 for r in drawn.where(F.col("stratum").isin(list(found))).groupBy("stratum").agg(F.max("step")).collect()}
    total = lambda s, step, of: sum(c[of] for c in found[s]["counts"] if c["first"] is not None and c["first"] <= step)
    n = {s: r["n"] for s, r in found.items()}
    passed = certified({s: [total(s, i, "good") for i in range(n_steps[s])] for s in found}, n, alpha, delta)
    used = []
    for s, k in passed.items():
        gains = [total(s, i, "bad") - PRICE * total(s, i, "good") for i in range(k)]
        if gains and max(gains) > 0:
            used.append((s, gains.index(max(gains)), n[s]))
    names = F.array(*map(F.lit, RULES))
    last = F.array(*map(F.lit, RULES.values()))
    on = spark.createDataFrame(used, "stratum string, step int, n_good long")
    return drawn.join(on, ["stratum", "step"]).where(F.col("cutoff") <= F.get(last, F.col("rule"))).select("stratum", "rule", F.get(names, F.col("rule")).alias("name"), "cutoff", "n_good")


def judge(measured_docs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add kept and the names of the rules that reject."""
    lists = cutoffs.groupBy("stratum").agg(F.collect_list(F.struct("rule", "name", "cutoff")).alias("cuts"))
    joined = measured_docs.join(lists, "stratum", "left")
    hit = F.filter(F.coalesce("cuts", F.array().cast(lists.schema["cuts"].dataType)), lambda c: F.get(F.col("bins"), c["rule"]) >= c["cutoff"])
    out = joined.withColumn("rejected_by", F.transform(hit, lambda c: c["name"]))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cuts", "bins", "key")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document with its counts, base verdict, the rules that reject it and kept."""
    table = written(features(docs), "quality-features")
    return judge(table, written(thresholds(docs.sparkSession, table, labels, alpha, delta), "quality-cutoffs"))


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    cutoffs = written(thresholds(docs.sparkSession, written(features(docs), "quality-features"), labels, alpha, delta), "quality-cutoffs")
    return unpacked_rows(judge(features(docs, carry=True), cutoffs).where("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL: dict[str, str] = {}
