import random
import re

import pytest
import xxhash

from sparkann.llm import simhash
from sparkann.llm.components import components
from tests.llm import cases


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest doc_id reachable for each (doc_id, print)."""
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(n)]


def test_documents_and_odd_cases(spark, tmp_path):
    source = cases.texts(200) + cases.odd()
    rows = simhash.op4_simhash(spark, cases.folder(spark, tmp_path, source)).collect()
    prints = [(d, brute_print(t)) for d, t, _ in source]
    want = [(d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints))]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_link_is_lost(spark, seed):
    rnd = random.Random(seed)
    seeds = [rnd.getrandbits(64) for _ in range(30)]
    prints = set()
    for s in seeds:  # chains and dense groups of fingerprints up to four bits apart
        for _ in range(25):
            x = s
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
            if rnd.random() < 0.3:
                s = x
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.ball_links(spark.createDataFrame([(signed(x),) for x in prints], "fp long")).collect()
    assert all((r.a ^ r.b).bit_count() <= 3 if r.a * r.b >= 0 else ((r.a ^ r.b) & simhash_mask).bit_count() <= 3 for r in links)
    got = {(r.node): r.root for r in components(spark.createDataFrame([tuple(r) for r in links], "a long, b long")).collect()}
    want = brute_components([(signed(x), x) for x in prints])
    assert [got.get(signed(x), signed(x)) for x in prints] == want


simhash_mask = (1 << 64) - 1


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, 199), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 199: 199, 200: 199, 300: 300, 301: 300}


def test_one_of_each_keeps_rows_whole(spark):
    docs = cases.frame(spark, [(5, "the same text again and again", "en"), (4, "the same text again and again", "fr"), (4, "the same text again and again", "fr"), (None, "the same text again and again", "de"), (7, None, None), (8, "", "en"), (9, "another text that differs from all", "en")])
    rows = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id, r.lang, r.row) for r in rows if r.doc_id != 7) == [(4, "fr", "r"), (9, "en", "r")]
    assert [r.text for r in rows if r.doc_id == 7] == [None] and len(rows) == 3


def test_empty(spark):
    assert simhash.near_duplicates(cases.frame(spark, [])).collect() == []
