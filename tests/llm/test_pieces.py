import random

import pytest
import sentencepiece

from sparkann.llm import pieces
from tests.llm import cases

ODD = ["", " ", "  a", "a  b ", "日本語 テスト", "\n\n a\tb", "x▁y ▁", "é" * 30, "a" * 5000, "🙂 ok ​", "<s> </s> <0x0A>", " \n "]


@pytest.fixture(scope="module")
def held():
    return pieces.Pieces(pieces.default_model())


def texts():
    return [t for _, t, _ in cases.texts(60)] + ODD


def test_rate_zero_is_the_plain_segmentation(held):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for t in texts():
        if "▁" not in t and "<" not in t:
            assert held.encode(t, 0, 0.0) == library.encode(t)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_round_trip(held, rate):
    for i, t in enumerate(texts()):
        assert held.decode(held.encode(t, i, rate)) == t


def merged_by_brute_force(held, text, key, rate):
    """One merge at a time over a list; candidates that the hash skips stay skipped while their parts last."""
    symbols, skipped = [(i, c) for i, c in enumerate(text)], set()
    limit = int(rate * (1 << 32))
    while True:
        options = [(held.rank[a + b], i, k) for k, ((i, a), (_, b)) in enumerate(zip(symbols, symbols[1:])) if a + b in held.rank and (i, a, b) not in skipped]
        if not options:
            return [x for _, s in symbols for x in held._out(s)]
        _, i, k = min(options)
        a, b = symbols[k][1], symbols[k + 1][1]
        if limit and ((((key ^ (i * pieces.STEP + len(a + b) * pieces.TURN)) * pieces.MIX) & pieces.MASK) >> 32) < limit:
            skipped.add((i, a, b))
        else:
            symbols[k : k + 2] = [(i, a + b)]


def test_dropout_against_brute_force(held):
    rnd = random.Random(4)
    for _ in range(300):
        word = " " + "".join(rnd.choice("theroningsatlywhé") for _ in range(rnd.randint(1, 14)))
        key = rnd.getrandbits(64)
        assert held.segment(word, key, 0.3) == merged_by_brute_force(held, word, key, 0.3)


def test_batches_give_what_single_segments_give(held):
    rnd = random.Random(5)
    words = [" " * rnd.randint(0, 3) + "".join(rnd.choice("theroningsatly 日é▁") for _ in range(rnd.randint(1, 60))) for _ in range(2000)]
    keys = [rnd.getrandbits(64) for _ in words]
    for rate in (0.0, 0.3):
        assert held.segment_many(words, keys, rate) == [held.segment(w, k, rate) for w, k in zip(words, keys)]


def test_seeds_vary_and_repeat(held):
    t = cases.texts(3)[0][1]
    assert held.encode(t, 1, 0.2, seed=1) == held.encode(t, 1, 0.2, seed=1)
    assert len({tuple(held.encode(t, 1, 0.2, seed=s)) for s in range(5)}) == 5
    assert len(held.encode(t, 1, 0.0)) < len(held.encode(t, 1, 0.2))


@pytest.mark.parametrize("remembered", [10, 600_000])
def test_what_is_remembered_changes_nothing(held, monkeypatch, remembered):
    monkeypatch.setattr(pieces, "REMEMBERED", remembered)
    held._forget()
    for rate in (0.1, 0.4):
        for i, t in enumerate([*texts()[:25], "one two  two 日本 日本 " * 200]):
            parts, keys = held.parts(t, i, 9)
            assert held.encode(t, i, rate, 9) == [x for w, k in zip(parts, keys.tolist()) for x in held.segment(w, k, rate)]


def test_query_on_odd_cases(spark, tmp_path):
    source = cases.texts(30) + cases.odd() + cases.long()
    rows = pieces.op7_merge_dropout(spark, cases.folder(spark, tmp_path, source)).collect()
    assert len(rows) == len(source) and all(r.lossless for r in rows)
    assert {r.n_ids for r in rows if r.doc_id in (1000, 1001)} == {0}
    assert pieces.encode(cases.frame(spark, []), pieces.default_model()).collect() == []


def test_each_occurrence_is_varied_on_its_own(held):
    words = [" " + w for w in ("the", "and", "this", "something")]
    for word in words:
        text = (word * 4000)[1:]
        parts, keys = held.parts(text, 7, pieces.SEED)
        assert parts == [word] * 4000 and len(set(keys.tolist())) == 4000
        single = [held.segment(word, k, 0.1) for k in keys.tolist()]
        assert held.encode(text, 7) == [x for ids in single for x in ids]
        plain = held.segment(word, 0, 0.0)
        # Each merge is skipped in a tenth of the occurrences, after which another way may lead to the same ids.
        assert 0.9 ** (len(word) - len(plain)) - 0.03 < sum(x == plain for x in single) / 4000 < 0.95
        assert held.encode(text, 7) != held.encode(text, 8)
    assert len({tuple(held.segment(words[-1], k, 0.1)) for k in keys.tolist()}) > 4
