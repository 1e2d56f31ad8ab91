import random

import pytest

from sparkann.llm import mtree


def brute(rows, every=100, k=10):
    usable = [(i, [int(x * 1024 // 1) for x in v]) for i, v in rows if v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    out = set()
    for q, a in usable:
        if q is not None and q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i is not None and i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("n, dim, copies", [(1500, 8, 0), (1200, 4, 500), (30, 3, 0)])
def test_brute_force(spark, n, dim, copies):
    rnd = random.Random(n)
    centres = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + rnd.gauss(0, 0.1) for c in rnd.choice(centres)]) for i in range(n)]
    rows[:copies] = [(i, rows[0][1]) for i in range(copies)]  # one vector very common: ties everywhere
    rows += [(100_000, None), (100_100, [float("nan")] * dim), (100_200, [None] + [0.5] * (dim - 1)), (100_300, [float("inf")] * dim)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, vec string").repartition(3)
    exact = [(i, v) for i, v in ((r[0], r[1]) for r in df.select("vec_id", "embedding").collect())]
    assert found(mtree.top_k(df)) == brute(exact)


def test_pruning_leaves_pages_out():
    import numpy as np

    rnd = np.random.default_rng(1)
    vectors = np.concatenate([rnd.normal(c, 3, (100, 4)) for c in (-500, 0, 500)]).astype(np.int64)
    space = mtree.Space(4, int((vectors**2).sum(axis=1).max()))
    pages = {p[0]: (p[1], p[2], space.held(p[3]), *p[4:]) for p in mtree.bulk_load(np.arange(300), vectors, space)}
    seen = []

    class Watched(dict):
        def __getitem__(self, page):
            seen.append(page)
            return super().__getitem__(page)

    best = mtree.search(Watched(pages), space, -1, space.held(vectors[250]), -float("inf"), 10)
    scores = sorted(((int(vectors[250] @ v), -i) for i, v in enumerate(vectors)), reverse=True)[:10]
    assert sorted(best, reverse=True) == [(s, -i) for s, i in scores]
    assert len(seen) < len(pages)


def test_empty(spark):
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
