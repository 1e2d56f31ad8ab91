import zlib

import numpy as np

from sparkann.llm import langid
from tests.llm import cases


def test_held_out_accuracy_and_odd_cases(spark, tmp_path):
    source = cases.texts(200) + cases.odd()
    rows = langid.op5_language_id(spark, cases.folder(spark, tmp_path, source)).collect()
    assert len(rows) == len(source)
    texts = {d: t for d, t, _ in source}
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert r.lang_pred == "und" and r.score == 0
        else:
            assert r.lang_pred in {"en", "de", "fr", "es"}
    langs = {d: lang for d, _, lang in cases.texts(200)}
    held = [r for r in rows if r.held_out and r.doc_id in langs]
    assert len(held) > 30
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95


def viterbi_brute(scores, penalty):
    """Best path of one text, by dynamic programming on lists."""
    value, back = list(scores[0]), []
    for s in scores[1:]:
        best = max(range(len(value)), key=lambda i: (value[i], -i))
        step = [i if value[i] >= value[best] - penalty else best for i in range(len(value))]
        back.append(step)
        value = [(value[i] if step[i] == i else value[best] - penalty) + s[i] for i in range(len(value))]
    at = max(range(len(value)), key=lambda i: (value[i], -i))
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return path[::-1]


def test_viterbi_against_one_text_at_a_time():
    rng = np.random.default_rng(1)
    lengths = np.array(sorted(rng.integers(1, 30, 20), reverse=True))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    scores = rng.normal(0, 4, (int(lengths.sum()), 3)).astype(np.float32)
    got = langid.viterbi(scores, starts, lengths, 3.0)
    for a, n in zip(starts, lengths):
        assert got[a : a + n].tolist() == viterbi_brute(scores[a : a + n].astype(float).tolist(), 3.0)


def test_spans_of_mixed_text_and_scripts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house is big and the garden is small", "en"), ("das Haus ist gross und der Garten ist klein", "de"), ("дом большой а сад маленький", "ru")] * 30)]
    model = langid.fit(cases.frame(spark, rows))
    assert model.languages == ["de", "en", "ru"]
    score = langid.Scorer(model)
    mixed = "the garden is big and the house is small das Haus ist klein und der Garten ist gross дом маленький сад большой"
    pred, share, spans = langid.label([mixed], score)[0]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert [(s["first_word"], s["last_word"]) for s in spans] == [(0, 8), (9, 17), (18, 21)]
    assert pred in ("de", "en") and 0.3 < share < 0.6
    assert langid.label(["12 34 !?", None, ""], score) == [("und", 0.0, [])] * 3


def test_nothing_to_learn_from(spark):
    docs = cases.frame(spark, [(1, "some text", None), (2, None, "en")])
    model = langid.fit(docs)
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, model).collect()] == [("und", 0.0)] * 2
    assert langid.identify(cases.frame(spark, []), model).collect() == []
