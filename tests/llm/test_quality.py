import hashlib
import random
import re
import zlib
from collections import Counter
from math import ceil, comb

from sparkann.llm import quality
from tests.llm import cases


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_counts_on_documents_and_odd_cases(spark, tmp_path):
    source = cases.texts(200) + cases.odd() + cases.long() + [(4000, "a b c a b c\n \na b c a b c\nx\nx", "en"), (4001, "\x1c w\x85 v\xa0u  t", "en")]
    rows = quality.op9_quality_rules(spark, cases.folder(spark, tmp_path, source, [(0, 1, 0), (None, 1, 0), (1, None, 0)])).collect()
    assert sorted((tuple(r)[:7] for r in rows), key=str) == sorted(((d, *brute(t)) for d, t, _ in source), key=str)
    assert all(r.kept == (not r.base_failed) for r in rows)  # hardly any labels: nothing can be certified


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.1), (200, 0.02), (50, 0.5)):
        for k in range(n + 1):
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            got = quality.binomial_tail(k, n, p)
            assert abs(got - want) < 1e-9 or k > n * p and got == 1.0


def test_paths_begin_mild_and_get_stricter():
    none = [{} for _ in quality.RULES]
    assert quality.path([{0: 50}, *none[1:]], none) == []  # nothing bad to catch
    steps = quality.path([{0: 50, 6: 1}, *none[1:]], [{10: 30, 5: 30}, *none[1:]])
    assert [s[0] for s in steps] == [41, 31, 21, 10, 5]  # margins above 10, then one good text for thirty more bad ones
    assert all(s[1:] == [51] * 5 for s in steps)


def test_certified_steps():
    assert quality.certified({"a": [0, 0, 5]}, {"a": 200}, 0.02, 0.05) == {"a": 2}
    assert quality.certified({"a": [0]}, {"a": 140}, 0.02, 0.05) == {"a": 0}  # too few texts
    assert quality.certified({"a": [0], "b": [0]}, {"a": 190, "b": 160}, 0.02, 0.05) == {"a": 1, "b": 1}  # b by the share that a passes on
    assert quality.certified({"a": [0, 9], "b": [0]}, {"a": 190, "b": 160}, 0.02, 0.05) == {"a": 1, "b": 0}
    assert quality.certified({}, {}, 0.02, 0.05) == {}


def plain_metrics(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.split()]
    n, chars = len(words), sum(map(len, words))
    count = lambda letters: sum(text.count(c) for c in letters)
    b = brute(text)
    shares = [(b[2], 2 * n), (b[3], len(lines)), (b[4], n), (count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars), (count("!?~^_=+{}[]\\@/"), 2 * n)]
    return [int(50 * min(1, x / of)) if of else 0 for x, of in shares] + [int(50 * (1 - len(set(words)) / n))]


def verdicts(source, labels):
    """kept of each document, by plain loops over labelled texts."""
    quality_of = {}
    for (d, t, lang), good in zip(source, labels):
        if good is not None and not brute(t)[-1]:
            key = (lang, t)
            quality_of[key] = max(good, quality_of.get(key, 0))
    texts = {k: (q, plain_metrics(k[1]), zlib.crc32(hashlib.md5(k[1].encode()).digest()) % 5 == 0) for k, q in quality_of.items()}
    plans, rejected, n = {}, {}, {}
    for lang in {k[0] for k in texts}:
        own = [v for k, v in texts.items() if k[0] == lang]
        tuning, test = [(q, m) for q, m, t in own if t], [(q, m) for q, m, t in own if not t]
        options = lambda i: [(c, sum(m[i] >= c for q, m in tuning if q == 0), sum(m[i] >= c for q, m in tuning if q == 1)) for c in range(50, 0, -1)]

        def best(i, price):
            top = 51, 0
            for c, b, g in options(i):
                if b and b - (price * g if g else 0) > top[1]:
                    top = c, b - (price * g if g else 0)
            return top[0]

        safe = [best(i, 10**9) for i in range(6)]
        steps = [[c + ceil((51 - c) * m) for c in safe] for m in (0.75, 0.5, 0.25, 0)]
        for price in (50, 20, 10, 5, 2, 1):
            steps.append([min(c, best(i, price)) for i, c in enumerate(steps[-1])])
        steps = [s for i, s in enumerate(steps) if s != ([51] * 6, *steps)[i]]
        if steps:
            hits = lambda s, want: sum(any(x >= c for x, c in zip(m, s)) for q, m in test if q == want)
            plans[lang], n[lang] = steps, sum(q for q, _ in test)
            rejected[lang] = [(hits(s, 1), hits(s, 0)) for s in steps]
    enough = {s for s in plans if 0.98 ** n[s] <= 0.05}
    passed = quality.certified({s: [g for g, _ in rejected[s]] for s in plans if s in enough}, n, 0.02, 0.05)
    chosen = {}
    for s, k in passed.items():
        gains = [b - 20 * g for g, b in rejected[s][:k]]
        if gains and max(gains) > 0:
            chosen[s] = plans[s][gains.index(max(gains))]
    return [not brute(t)[-1] and not any(x >= c for x, c in zip(plain_metrics(t), chosen.get(lang, [51] * 6))) for _, t, lang in source], chosen


def test_verdicts_against_plain_loops(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7)))
    source, labels = [], []
    for lang, good, bad in (("en", 700, 120), ("de", 420, 60), ("fr", 60, 20)):
        for i in range(good + bad):
            junk = rnd.choice(["", "", "#"]) if i < good else rnd.choice(["#*", "#", "!!!"])
            text = " ".join(word() + junk * (rnd.random() < 0.6) for _ in range(rnd.randint(45, 80)))
            copies = 1 + 2 * (i % 50 == 0)
            source += [(len(source) + k, text, lang) for k in range(copies)]
            labels += [int(i < good) if rnd.random() < 0.9 else None for _ in range(copies)]
    want, chosen = verdicts(source, labels)
    assert {"en", "de"} <= set(chosen) and "fr" not in chosen
    held = spark.createDataFrame([(d, good, 0) for (d, _, _), good in zip(source, labels)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.quality_rules(cases.frame(spark, source), held).collect()}
    assert [got[d] for d, _, _ in source] == want
    assert {r.doc_id for r in quality.kept_documents(cases.frame(spark, source), held).collect()} == {d for (d, _, _), k in zip(source, want) if k}


def test_false_rejections_stay_limited(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7)))
    good = [" ".join(word() for _ in range(60)) for _ in range(4000)]
    bad = [" ".join(word() + rnd.choice("#*") for _ in range(60)) for _ in range(300)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 4000), 0) for i in range(4300) if i % 10], "doc_id long, quality int, toxic int")
    docs = cases.frame(spark, rows)
    kept = {r.doc_id for r in quality.kept_documents(docs, labels).collect()}
    assert len(kept & set(range(4000))) >= 4000 * (1 - quality.ALPHA)
    assert not kept & set(range(4000, 4300))
    assert {r.doc_id for r in quality.quality_rules(docs, labels).where("kept").collect()} == kept


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(cases.frame(spark, []), labels).collect() == []
    out = quality.kept_documents(cases.frame(spark, cases.odd()), labels)
    assert out.columns == cases.frame(spark, []).columns and all(r.row == "r" for r in out.collect())
