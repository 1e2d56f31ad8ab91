import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from sparkann.llm import packing
from tests.llm import cases


def test_documents_and_odd_cases(spark, tmp_path):
    source = cases.texts(120) + cases.odd() + cases.long()
    rows = packing.op10_best_fit_packing(spark, cases.folder(spark, tmp_path, source)).collect()
    tokens = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for d, t, _ in source:
        ids = np.array([*tokens.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 1024
    total = sum(r.length for r in rows)
    assert len(held) <= -(-total // 1024) * 1.05 + 2


def optimum(sizes, capacity):
    """Least number of bins, by trying all ways."""

    @cache
    def most(left):
        if not left:
            return 0
        w, rest = left[0], left[1:]
        best = None
        for mask in range(1 << len(rest)):
            own = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if w + sum(own) <= capacity:
                n = 1 + most(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1))
                best = n if best is None else min(best, n)
        return best

    return most(tuple(sorted(sizes, reverse=True)))


def test_reduction_keeps_the_optimum():
    rnd = random.Random(2)
    reduced = 0
    for _ in range(120):
        capacity = rnd.choice([10, 15, 20])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        left = dict(Counter(sizes))
        fixed = packing.reduce_dominated(left, capacity)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sorted([n for p, k in fixed for n in p * k] + rest) == sorted(sizes)
        assert sum(k for _, k in fixed) + optimum(rest, capacity) == optimum(sizes, capacity)
        reduced += len(sizes) - len(rest)
    assert reduced > 300


def test_three_pieces_can_dominate():
    fixed = packing.reduce_dominated(left := {10: 1, 6: 1, 4: 1, 3: 1}, 20)
    assert fixed[0] == ((10, 6, 4), 1) and not left[10]
    assert packing.dominating(11, {11: 1, 5: 1, 4: 2, 3: 1}, 20) == (5, 4)
    assert packing.dominating(11, {11: 1, 6: 1, 5: 1, 4: 1, 3: 1}, 20) is None  # 5 and 4 are longer than 6, and 4 than 3


def test_plan_packs_everything_in_any_number():
    rnd = random.Random(3)
    for scale in (1, 10_000):
        counts = {i: rnd.randint(0, 50) * scale for i in range(1, 1025)}
        patterns = packing.plan(counts)
        got = Counter()
        for p, k in patterns:
            assert sum(p) <= 1024 and k > 0
            for n in p:
                got[n] += k
        assert got == Counter({n: c for n, c in counts.items() if c})
        assert sum(k for _, k in patterns) <= 1.03 * sum(n * c for n, c in counts.items()) / 1024 + 2
        assert len(patterns) < 20_000


def test_empty(spark):
    assert packing.pack(cases.frame(spark, []), packing.default_tokenizer()).collect() == []
