import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from sparkann.llm import repeats
from tests.llm import cases


def brute(texts, length):
    counts = Counter(d[i : i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for d in texts:
        mark = [False] * len(d)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                mark[i : i + length] = [True] * length
        kept = bytes(x for x, m in zip(d, mark) if not m)
        out.append((len(d), sum(mark), sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


def brute_runs(lists, words):
    """Items of each list that a repeated run of so many covers, and maximal runs of them."""
    counts = Counter(tuple(d[i : i + words]) for d in lists for i in range(len(d) - words + 1))
    out = []
    for d in lists:
        mark = [False] * len(d)
        for i in range(len(d) - words + 1):
            if counts[tuple(d[i : i + words])] > 1:
                mark[i : i + words] = [True] * words
        out.append((sum(mark), sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 90))) for _ in range(50)]
    docs = []
    for b in base:
        docs.append(b)
        if rnd.random() < 0.6:
            x = list(b)
            for _ in range(rnd.randint(0, 3)):
                if x:
                    x[rnd.randrange(len(x))] = rnd.choice("abcx")
            docs.append("".join(x))
        if rnd.random() < 0.4:
            docs.append(rnd.choice(base) + "a passage that very many share" + rnd.choice(base))
    return [*docs, "", "a" * 100, "ab" * 60, "x" * 19, "x" * 20, "x" * 20, None, "zz" + "q" * 25 + "yy", "q" * 24]


@pytest.mark.parametrize("length, anchor, hot", [(20, 10, 1000), (20, 10, 3), (12, 4, 2)])
def test_brute_force(spark, length, anchor, hot):
    docs = corpus(length + hot)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    rows, texts, kept, _ = repeats.remove_repeats(df, length, anchor, hot)
    rows = {r.doc_id: r for r in rows.join(texts, ["t1", "t2"]).collect()}
    kept = {(r.t1, r.t2): r for r in kept.collect()}
    got = []
    for i in range(len(docs)):
        r, k = rows[i], kept.get((rows[i].t1, rows[i].t2))
        if r.copies > 1 and r.n_bytes >= length:
            got.append((r.n_bytes, r.n_bytes, 1, hashlib.sha256(b"").hexdigest()))
        elif k:
            got.append((r.n_bytes, sum(s.b - s.a for s in k.spans), len(k.spans), hashlib.sha256(k.kept).hexdigest()))
        else:
            got.append((r.n_bytes, 0, 0, bytes(r.sha256).hex()))
    assert got == brute([(d or "").encode() for d in docs], length)


def test_index_marks_what_sorting_all_strings_marks():
    rnd = random.Random(9)
    base = bytes(rnd.choice(b"ab") for _ in range(400))
    strings = [base[a : a + 60] + bytes([c]) for a, c in ((0, 99), (5, 100), (200, 101), (205, 99), (5, 102))] + [b"abab" * 20]
    index = repeats.RunLengthIndex(strings, 30)
    mask = index.marked()
    want = brute(strings, 30)
    assert [int(mask[a:b].sum()) for a, b in zip(index.begins, index.stops)] == [w[1] for w in want]
    assert len(index.first) < sum(max(len(s) - 29, 0) for s in strings)  # runs compress


def test_runs_lead_through_the_strings():
    rnd = random.Random(12)
    base = bytes(rnd.choice(b"abc") for _ in range(300))
    strings = [base[a : a + n] + bytes([rnd.choice(b"xy")]) for a, n in ((0, 90), (10, 80), (0, 40), (100, 150), (90, 100))] + [b"a" * 120, b"ab" * 70, b"short"]
    index = repeats.RunLengthIndex(strings, 30)
    for s, row in zip(strings, index.last.tolist()):
        read = []
        for _ in range(max(len(s) - 30, 0)):  # from the last suffix to the first, by LF steps over runs alone
            run = int((index.first <= row).sum()) - 1
            read.append(index.byte[run])
            row = index.leads[run] + row - index.first[run]
        assert bytes(read[::-1]) == s[: max(len(s) - 30, 0)]


@pytest.mark.parametrize("seed", range(20))
def test_index_on_random_strings(seed):
    rnd = random.Random(seed)
    base = bytes(rnd.choice(b"ab" if seed % 2 else b"abcd") for _ in range(200))
    strings = []
    for _ in range(rnd.randint(1, 12)):
        a = rnd.randrange(150)
        x = bytearray(base[a : a + rnd.randint(0, 120)])
        if x and rnd.random() < 0.5:
            x[rnd.randrange(len(x))] = 120
        strings.append(bytes(x))
    strings = list(dict.fromkeys(strings))
    length = rnd.choice([5, 9, 16, 30])
    index = repeats.RunLengthIndex(strings, length)
    mask = index.marked()
    assert [int(mask[a:b].sum()) for a, b in zip(index.begins, index.stops)] == [w[1] for w in brute(strings, length)]


def test_sorting_by_comparisons_gives_the_same_index(monkeypatch):
    strings = [b"a" * 300, b"ab" * 150, b"a" * 200 + b"b" + b"a" * 99]
    want = repeats.RunLengthIndex(strings, 50).marked()
    monkeypatch.setattr(repeats, "COPIED", 100)
    assert (repeats.RunLengthIndex(strings, 50).marked() == want).all()


def test_query_on_documents_and_odd_cases(spark, tmp_path):
    passage = "This passage stands in several documents, word for word, and is longer than four hundred bytes. " * 5
    source = cases.texts(40) + cases.odd() + [(2000 + i, f"own start {i} " + passage + f" own end {i}", "en") for i in range(3)]
    got = repeats.op3_suffix_dedup(spark, cases.folder(spark, tmp_path, source)).collect()
    texts = [(t or "").encode() for _, t, _ in source]
    want = [(d, *w, len(t.split()), *v) for (d, _, _), t, w, v in zip(source, texts, brute(texts, 400), brute_runs([t.split() for t in texts], 51))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_very_long_texts(spark, tmp_path):
    got = {r.doc_id: r for r in repeats.op3_suffix_dedup(spark, cases.folder(spark, tmp_path, cases.long() + cases.texts(20))).collect()}
    for d, t, _ in cases.long():  # all of them repeat themselves throughout
        r, n = got[d], len(t.split())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t.encode()), len(t.encode()), 1)
        assert (r.n_words, r.n_passage_words) == (n, n if n > 51 else 0)


def test_sql_agrees(spark, tmp_path):
    source = cases.texts(60) + [(5000 + i, "x" * 399 + "é" * i, "en") for i in range(3)] + [(5010, None, None), (5011, "a" * 2000, "en")]
    folder = cases.folder(spark, tmp_path, source)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.sql(repeats.SQL["op3_suffix_dedup"]).fetchall()
    got = repeats.op3_suffix_dedup(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_cut_documents_keep_their_columns(spark):
    passage = "x".join(str(i) for i in range(300))
    docs = cases.frame(spark, [(1, "aé" + passage, "en"), (2, "bb" + passage, "en"), (3, None, None), (4, "short", "en")])
    out = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert {i: r.text for i, r in out.items()} == {1: "aé", 2: "bb", 3: None, 4: "short"}
    assert out[1].n_chars == 2 and out[1].row == "r" and out[1]["a.b"] == 1


def brute_words(texts, words):
    """The words of each text that no repeated run of so many words covers."""
    split = [t.split() for t in texts]
    counts = Counter(tuple(d[i : i + words]) for d in split for i in range(len(d) - words + 1))
    return [[w for k, w in enumerate(d) if not any(counts[tuple(d[i : i + words])] > 1 for i in range(max(0, k - words + 1), min(k, len(d) - words) + 1))] for d in split]


def test_pipeline_cuts_passages_of_over_50_words(spark):
    rnd = random.Random(4)
    own = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(90)) for _ in range(n))
    texts = []
    for n in (50, 51, 52, 55, 60, 61, 100):  # of about 150 to 350 bytes, so none is a long string
        passage = own(n)
        texts += [own(70) + " " + passage + " " + own(60), own(30) + "\n" + passage, passage + " " + own(55)]
    mixed = own(40)  # repeats next to one another, each of them short
    texts += [own(40) + " " + mixed + " " + own(9), texts[0][:60] + " " + mixed + " x", "é " + own(80), own(10), own(10)]
    docs = cases.frame(spark, [(i, t, "en") for i, t in enumerate([*texts, None])])
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert [got[i].split() for i in range(len(texts))] == brute_words(texts, 51)
    assert got[len(texts)] is None


def test_empty(spark):
    rows, texts, kept, passages = repeats.remove_repeats(cases.frame(spark, []), words=51)
    assert rows.collect() == [] and texts.collect() == [] and kept.collect() == [] and passages.collect() == []


def test_scans_match_plain_loops():
    """Sliding extremes of any width, segments of texts in one part, and codes of words."""
    rnd = random.Random(12)
    for width in (1, 2, 3, 4, 5, 8, 13, 201):
        for n in (width, width + 1, 2 * width, 700):
            x = np.array([rnd.getrandbits(64) for _ in range(max(n, width))], np.uint64)
            for pick, plain in ((np.minimum, min), (np.maximum, max)):
                want = [plain(x[i : i + width].tolist()) for i in range(len(x) - width + 1)]
                assert repeats.sliding(x, width, pick).tolist() == want
    texts = [bytes(rnd.randrange(97, 100) for _ in range(n)) for n in (20, 35, 0, 64, 20, 300)]
    rolling = repeats.Rolling(repeats.BASES[0])
    found = [x for part in repeats.segments(texts, rolling, 20, 9) for x in zip(*(y.tolist() for y in part), strict=True)]
    want = []
    for i, text in enumerate(texts):
        least = [min(rolling(np.frombuffer(text[a : a + 20], np.uint8), 9).tolist()) for a in range(len(text) - 19)]
        new = [a for a, h in enumerate(least) if not a or h != least[a - 1]]
        want += [(i, a, b - a, least[a]) for a, b in zip(new, [*new[1:], len(least)], strict=False)]
    assert [x[:4] for x in found] == want
    words = [b"one", b"", b"\xff" * 99]
    assert repeats.code_of(words) == b"".join(xxhash.xxh64_digest(w)[:6] for w in words) and repeats.code_of([]) == b""
