import hashlib
import random
import re
from collections import Counter
from math import exp

import regex

from sparkann.llm import pii
from tests.llm import cases

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(kind), m.end()))
    return sorted(out)


ODD = [
    "a@b.c", "a@b.c+d@e.f x@y@z.com a@b@c.d.e", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111",
    "+1 (403) 555-9312 and +44 20 7946 0958 ( +1 +12 +12345678901234567", "é" * 50 + " 🙂 jo.do@ex.org", "1" * 500, "a" * 20_000 + "@", "+" * 100 + "1" * 10,
    " ".join(f"10.0.{i // 256}.{i % 256}" for i in range(500)), "1 " * 3000, "a.b%c-d@e-f.g-h.i.", "@@..++--", "x@y.z" * 50,
]


def test_base_spans(spark, tmp_path):
    source = cases.texts(150) + cases.odd() + [(3100 + i, t, "en") for i, t in enumerate(ODD)]
    rows = pii.op6_pii(spark, cases.folder(spark, tmp_path, source)).collect()
    want = []
    for d, t, _ in source:
        spans = brute(t)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((d, *(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted(want, key=str)
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in rows)
    texts = {d: brute(t) for d, t, _ in source}
    for r in rows:  # added or not, base spans are there
        own = set(r.spans.split(",")) - {""}
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in texts[r.doc_id]} <= own


def luhn(value):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(re.sub("[^0-9]", "", value))))) % 10 == 0


def loosely_valid(kind, value):
    n = len(re.sub("[^0-9]", "", value))
    if kind == "ip":
        return ":" in value or all(int(x) <= 255 for x in re.findall("[0-9]+", value))
    if kind == "card":
        return bool(re.search(pii.OTHER_GROUPS, value)) or 13 <= n <= 19 and not luhn(value)
    return kind == "email" or 8 <= n <= 15


def plain_candidates(text):
    """kind, base, start, end, votes of all candidates, by plain loops."""
    base = [(k, a, b) for a, k, b in brute(text)]
    out = []
    for k, kind in enumerate(pii.KINDS):
        for which, table in (("base", PATTERNS), ("loose", pii.LOOSE)):
            ends = [0, 0]
            for m in regex.finditer(table[kind], text):
                a, b, limit = m.start(), m.end(), ends[-2]
                ends.append(b)
                own = (k, a, b) in base
                if which == "base" and not own or which == "loose" and (not loosely_valid(kind, m.group()) or any(x < b and a < y for _, x, y in base)):
                    continue
                before, after = text[max(limit, a - pii.NEAR) : a], text[b : b + 1]
                form = 1 if own else (1 if 12 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and luhn(m.group()) else -1) if kind == "card" else 0
                votes = [
                    form,
                    -bool(regex.search(r"^\w|\w$", before[-1:] + " " + after, regex.ASCII)),
                    int(kind == "email") if regex.search(pii.GAZETTEER[kind], m.group()) else -1,
                    int(bool(regex.search(pii.FOR[kind], before))),
                    -bool(regex.search(pii.AGAINST, before)),
                    int(any(o != k and x < b + pii.NEAR and a < y + pii.NEAR for o, x, y in base)),
                ]
                out.append((kind, own, a, b, votes))
    return out


def test_added_spans_against_plain_loops(spark):
    rnd = random.Random(5)
    made = [m for m, _ in planted(rnd, 200)]
    texts = [t or "" for _, t, _ in cases.texts(150)] + ODD + made + [" ".join(rnd.sample(made, 6)) for _ in range(20)]
    found = [plain_candidates(t) for t in texts]
    number = lambda votes: sum((v + 1) * 3 ** (5 - i) for i, v in enumerate(votes))
    counts = Counter((kind, number(v)) for own in found for kind, _, _, _, v in own)
    weights = pii.classifier(sorted((k, v, n) for (k, v), n in counts.items()))
    score = lambda v: weights[0] + sum(weights[1 + i] * (x == 1) + weights[7 + i] * (x == -1) for i, x in enumerate(v))
    want = [sorted((a, pii.KINDS.index(k), b) for k, base, a, b, v in own if base or 1 / (1 + exp(-score(v))) >= pii.ACCEPT - 1e-9) for own in found]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(cases.frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(len(w) for w in want) > sum(base for own in found for _, base, *_ in own) + 50


def planted(rnd, n):
    """Texts with a loose form in each, and whether it is personal."""
    name = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    four = lambda: f"{rnd.randint(1000, 9999)}"
    out = []
    for _ in range(n):
        area, line = rnd.choice([212, 305, 415, 617]), rnd.randint(1000, 9999)
        out.append(rnd.choice([
            (f"Please write a mail to {name()} (at) {name()} (dot) com soon", True), (f"contact {name()}[at]{name()}.org for more", True),
            (f"my phone is {area}-555-{line} thanks", True), (f"tel: 030 {rnd.randint(10**6, 10**7 - 1)} in the mornings", True),
            (f"the host 8{rnd.randint(0, 9)}[.]41[.]7[.]{rnd.randint(2, 250)} answers", True), (f"the server address 2a02:8108::{rnd.randint(1, 99)}f is up", True),
            (f"serial {four()} {four()} {four()} {four()[:3]} on the back", False), (f"order no. {area}-555-{line} came", False),
            (f"they look at {name()}.html and {name()} at {name()}.xyzzy", False), (f"time 10:20::30 and version 192[.]168[.]1[.]{rnd.randint(2, 250)} here", False),
        ]))
    return out


def test_planted_truth(spark):
    rnd = random.Random(11)
    truth = planted(rnd, 600)
    sure = [f"Write a mail to jo{i}@corp{i}.com today, or call my phone +1 (415) 555-{2000 + i}." for i in range(100)]
    docs = cases.frame(spark, [(i, t, "en") for i, t in enumerate([t for t, _ in truth] + sure)])
    added = {r.doc_id: len(r.spans) > len(r.base) for r in pii.find(docs).collect()}
    caught = sum(added[i] for i, (_, personal) in enumerate(truth) if personal)
    wrong = sum(added[i] for i, (_, personal) in enumerate(truth) if not personal)
    assert caught >= 0.9 * sum(personal for _, personal in truth)
    assert wrong <= 0.05 * caught


def test_long_texts_with_many_spans(spark, tmp_path):
    """Texts of 50,000 spans are found and masked in a time that grows with them, not with their square."""
    spans = ",".join(f"email:{20 * i}:{20 * i + 10},ip:{20 * i + 11}:{20 * i + 19}" for i in range(25_000))
    for r in pii.op6_pii(spark, cases.folder(spark, tmp_path, cases.long())).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == ((25_000, 25_000, 0, 0, spans) if r.doc_id == 3004 else (0, 0, 0, 0, ""))
    masked = {r.doc_id: r.text for r in pii.mask(cases.frame(spark, cases.long())).collect()}
    assert masked == {d: "<EMAIL> <IP> " * 25_000 if d == 3004 else t for d, t, _ in cases.long()}


def test_votes_add_spans_in_context_only(spark):
    rows = [(i, f"Write a mail to jo{i}@corp{i}.com today.", "en") for i in range(30)] + [(100 + i, f"Call my phone +1 (415) 555-{2000 + i} now.", "en") for i in range(30)]
    rows += [(200, "Write a mail to bob (at) mail (dot) com please", "en"), (201, "my phone is 415-555-2671 thanks", "en"), (202, "the number 5731080387325255 means nothing", "en"), (203, "order no. 123-456-7890 came", "en")]
    found = {r.doc_id: r for r in pii.find(cases.frame(spark, rows)).collect()}
    added = lambda i: [(s.start, pii.KINDS[s.kind], s.end) for s in found[i].spans if s not in found[i].base]
    assert added(200) == [(16, "email", 39)]
    assert added(201) == [(12, "phone", 24)]
    assert added(202) == [] and added(203) == []
    assert all(found[i].base == found[i].spans for i in range(30))


def test_reliabilities_follow_agreement():
    pack = lambda v: int("".join(str(x + 1) for x in v), 3)
    found = [("email", pack([1, 0, 1, 1, 0, 0]), 900), ("email", pack([1, 0, -1, 1, 0, 0]), 20), ("email", pack([-1, 0, -1, 0, -1, 0]), 300)]
    right, post = pii.reliabilities(found)
    assert right[2] > 0.9 and post[0] > 0.9 and post[2] < 0.1
    weights = pii.classifier(found)
    odds = [sum(w * x for w, x in zip(weights, pii.features(pii.unpacked(v)))) for _, v, _ in found]
    assert odds[0] > 0 > odds[2]


def test_masking_keeps_rows_whole(spark):
    docs = cases.frame(spark, [(1, "é jo@ex.org or 10.1.2.3!", "en"), (2, None, None), (3, "nothing", "en"), (None, "", "en")])
    out = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert {i: r.text for i, r in out.items()} == {1: "é <EMAIL> or <IP>!", 2: None, 3: "nothing", None: ""}
    assert out[1].row == "r" and out[1]["a.b"] == 1 and out[1].n_chars == 24


def test_empty(spark):
    assert pii.find(cases.frame(spark, [])).collect() == []
