import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from sparkann.llm import simhash, similar
from sparkann.llm.common import written
from sparkann.llm.components import components
from tests.llm import cases


def brute_set(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(source):
    """The least doc_id of each component of texts with a Jaccard similarity of 0.8 or more."""
    sets, root = [brute_set(t) for _, t in source], list(range(len(source)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                root = [root[j] if r == root[i] else r for r in root]
    return {min(source[i][0] for i in range(len(source)) if root[i] == r) for r in set(root)}


def corpus(seed):
    rnd = random.Random(seed)
    line = [f"line{i}" for i in range(30)]
    texts = []
    for k in range(40):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([3, 6, 30, 120, 200]))]
        base = words + (line if k % 2 else [])  # a passage that many share
        texts.append(base)
        for _ in range(rnd.choice([0, 1, 2, 8])):
            x = list(base)
            for _ in range(rnd.randint(0, 1 + len(x) // 25)):
                x[rnd.randrange(len(x))] = f"w{rnd.randrange(500)}"
            texts.append(x)
    rnd.shuffle(texts)
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


def test_stage_drops_all_similar_texts_and_no_others(spark):
    for seed in (1, 2):
        source = [*corpus(seed), (900, None), (901, " \n"), (902, "A short  text"), (903, "a SHORT text")]
        docs = cases.frame(spark, [(d, t, "en") for d, t in source])
        assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == brute_kept(source)


def test_order_is_one_for_all(spark):
    common, turns = np.array([5, 9], np.uint64), np.array([2, 1], np.uint64)
    assert similar.ordered(np.array([3, 5, 9, 11], np.uint64), common, turns).tolist() == [3, 11, (1 << 63) + 1, (1 << 63) + 2]


def test_sketches_rule_out_no_link():
    rnd = random.Random(3)
    for n in (3, 40, 400, 3000):
        for same in (0.5, 0.8, 0.89, 0.95, 1.0):
            x = [rnd.getrandbits(63) for _ in range(n)]
            y = x[: int(n * same)] + [rnd.getrandbits(63) for _ in range(n - int(n * same))]
            a, b = (np.unique(np.array(v, np.uint64)) for v in (x, y))
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), *(pa.array([similar.sketch(v)], pa.binary()) for v in (a, b))], ["a", "b", "x", "y"])
            passed = next(similar.plausible(iter([batch]))).num_rows
            assert passed or len(np.intersect1d(a, b)) < similar.least_common(len(a), len(b))
            assert not passed or same > 0.5 or n == 3


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(similar, "bitmap", lambda fps: np.full(similar.BITS // 64, (1 << 64) - 1, np.uint64))
    source = corpus(3)
    assert {r.doc_id for r in similar.one_of_similar(cases.frame(spark, [(d, t, "en") for d, t in source])).collect()} == brute_kept(source)


def alike(seed):
    """Texts made from one, too far from one another to be linked but for some."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(60):
        x = list(base)
        for _ in range(rnd.choice([1, 3, 5, 7, 9])):
            x[rnd.randrange(len(x))] = f"v{rnd.randrange(10**6)}"
        texts.append(x)
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


def test_blocks_lose_no_link_and_make_few_pairs(spark, monkeypatch):
    for many, block in ((2, 7), (2, 1), (16, 1024)):
        monkeypatch.setattr(similar, "MANY", many)
        monkeypatch.setattr(similar, "BLOCK", block)
        for source in (alike(5), corpus(4)):
            docs = cases.frame(spark, [(d, t, "en") for d, t in source])
            assert {r.doc_id for r in similar.one_of_similar(docs).collect()} == brute_kept(source)


def test_blocks_meet_each_pair():
    """All pairs that sketches allow, each in one pair of blocks, and no pair of one component."""
    rnd = random.Random(6)
    sets = [np.unique(np.array([x for x in range(40) if rnd.random() > 0.04], np.uint64)) for _ in range(12)]
    fp = list(range(12))
    root = [f // 2 for f in fp]
    own = [f % 3 for f in fp]
    rows = [(7, f, len(sets[f]), 0, root[f], similar.sketch(sets[f]), own[f], min(own[f], x), max(own[f], x)) for f in fp for x in range(3)]
    names = ["token", "fp", "n", "place", "root", "held", "own", "i", "j"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    rnd.shuffle(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names) for part in (rows[:20], rows[20:])]
    found = [(a, b) for x in similar.to_plausible(iter(batches)) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)]
    wanted = {(a, b) for a in fp for b in fp[a + 1 :] if root[a] != root[b] and len(np.intersect1d(sets[a], sets[b])) >= similar.least_common(len(sets[a]), len(sets[b]))}
    assert len(found) == len(set(found)) and set(found) == wanted and wanted


def changed(seed):
    """Classes: many texts, each with copies of which a word or two are other ones, and what their sets share."""
    rnd = random.Random(seed)
    texts = []
    for k in range(25):
        base = [f"t{k}w{i}" for i in range(rnd.choice([4, 40, 150, 400]))]
        for edits in (0, 1, 1, 2):
            x = list(base)
            for _ in range(edits):
                x[rnd.randrange(len(x))] = f"v{rnd.randrange(10**6)}"
            texts.append(" ".join(x))
    return sorted(set(texts))


def test_stage_meets_by_fingerprints(spark, monkeypatch):
    """SimHash links all that are similar and whose fingerprints differ in five bits or fewer, without any shared shingles; the
    whole stage goes through it."""
    texts = [x.encode() for x in changed(7)]
    prints = {similar.class_of(x): simhash.fingerprint(x, 5) for x in texts}
    sets = {similar.class_of(x): similar.shingles(x) for x in texts}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(c), signed(p)) for c, p in prints.items()], "fp long, `print` long")
    slim = spark.createDataFrame([(x.decode(),) for x in texts], "text string")
    links = similar.print_links(written(nodes), slim).collect()
    assert all(len(np.intersect1d(sets[r.a % (1 << 64)], sets[r.b % (1 << 64)])) >= similar.least_common(len(sets[r.a % (1 << 64)]), len(sets[r.b % (1 << 64)])) for r in links)
    root = {r.node: r.root for r in components(spark.createDataFrame([tuple(r) for r in links], "a long, b long")).collect()}
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 5 and len(np.intersect1d(sets[a], sets[b])) >= similar.least_common(len(sets[a]), len(sets[b]))]
    assert sum((prints[a] ^ prints[b]).bit_count() > 3 for a, b in close) > 3
    assert all(root[signed(a)] == root[signed(b)] for a, b in close)
    seen = []
    monkeypatch.setattr(similar, "print_links", lambda nodes, slim, whole=similar.print_links: seen.append(written(whole(nodes, slim))) or seen[-1])
    source = [(i, x.decode()) for i, x in enumerate(texts)]
    kept = corpus_pipeline.near_dedup(spark, cases.frame(spark, [(d, t, "en") for d, t in source]), "").collect()
    assert {r.doc_id for r in kept} == brute_kept(source) and seen[0].count() >= len(links) > 0


def test_wider_balls_lose_no_link():
    """All pairs of fingerprints with up to five differing bits share a variant."""
    rnd = random.Random(8)
    for bits in (0, 1, 2, 3, 4, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), bits):
            y ^= 1 << b
        batch = pa.RecordBatch.from_arrays([pa.array(np.array([x, y], np.uint64).view(np.int64))], ["fp"])
        keys = next(simhash.variants(similar.PRINT_BLOCKS, similar.LEFT_OUT)(iter([batch])))["variant"].to_numpy()
        assert len(np.intersect1d(keys[: len(keys) // 2], keys[len(keys) // 2 :]))


def test_rows_stay_whole(spark):
    docs = cases.frame(spark, [(4, "the same text", "fr"), (4, "the same text", "fr"), (None, "the same text", "de"), (9, "another one", "en"), (None, "no id", "en")])
    rows = similar.one_of_similar(docs).collect()
    assert sorted(((r.doc_id, r.lang, r.row) for r in rows), key=str) == sorted([(4, "fr", "r"), (9, "en", "r"), (None, "en", "r")], key=str)
    assert similar.one_of_similar(cases.frame(spark, [])).collect() == []
