"""Personal data by weak-supervision aggregation, with DataFrame functions only (operator 6).

Base spans come from four patterns and their checks (octets, Luhn, digit counts). Loose patterns add candidates that no base
span overlaps: spelled-out addresses, IPv6 and defanged addresses, card numbers in other groups or with a wrong check digit,
numbers without country code. Labelers look at every candidate, base or loose, and vote 1 (personal), -1 (not) or 0
(abstain): a strict-format labeler, a boundary regex labeler, a gazetteer labeler (top-level domains, calling codes, card
issuers, reserved networks) and three context labelers (words in front that speak for or against, base spans of another kind
nearby). Only the counts of each vote pattern leave the cluster, 4 * 3^6 at most. On them, expectation-maximisation (after
Dawid and Skene, 1979) estimates how often each labeler is right when it votes, and with its posteriors as soft labels a
logistic regression is fitted: the final span classifier. Patterns weigh in by the logarithm of their count, as nearly all
candidates are base spans, which stay anyway, and would drown the others. A loose candidate stays if the classifier gives it ACCEPT
or more. Base spans always stay.

Time grows in proportion to a text and its spans: contexts are taken from the gaps between matches, spans are compared by blocks of
neighbours, and masked texts are put together from chunks.

Patterns are written so that Java's matcher neither recurses nor scans a run of characters again from each of its places;
they find what the plain patterns find.

Defined results: null text counts as empty and has no spans; offsets are code points, ends exclusive; repeated rows get
equal rows; a null doc_id stays null; without loose candidates nothing is added; an empty table gives an empty result.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkann.llm.common import documents, unpacked_rows, whole_row, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("format", "boundary", "gazetteer", "context", "counter_context", "company")
ACCEPT = 0.8
#: Votes right and wrong that each labeler is credited with, and the least and largest reliability.
PRIOR, BOUNDS = (8.0, 2.0), (0.55, 0.95)
#: Least posterior of a base span, which stays in any case and anchors the estimates.
SURE = 0.95
NEAR = 40  # characters before a span that count as its context
BLOCK = 64  # spans that are summed or compared at a time
CHUNK = 4096  # characters of a text that is masked in parts

LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20)"
DOT = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)"
HEX = "[0-9A-Fa-f]{1,4}"
LOOSE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}|[0-9]{{1,3}}(?:\x20?[\[(]\x20?(?:\.|dot)\x20?[\])]\x20?[0-9]{{1,3}}){{3}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9._/])|" + BASE["card"],
    "phone": r"(?<![0-9A-Za-z+(._/-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|\(?00?[1-9][0-9]{1,3}\)?(?:[\x20/.-][0-9]{2,8}){1,4})(?![0-9A-Za-z-])",
}
#: Without these no pattern of the kind can match; cheap to look for.
NEEDS = {("email", "base"): "@", ("phone", "base"): r"\+", ("ip", "base"): r"\.[0-9]", ("card", "base"): r"[0-9][\x20-]?[0-9]", ("email", "loose"): AT, ("ip", "loose"): r":[0-9A-Fa-f]|[0-9]\x20?[\[(]", ("phone", "loose"): r"[0-9]\)?[\x20/.-][0-9]{2}", ("card", "loose"): r"[0-9][\x20._/-]?[0-9]"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: What gazetteers know. Generic and country top-level domains, reserved networks of RFC 6890 and their like in
#: IPv6, first digits of card issuers, calling codes by zone (ITU-T E.164) and the form of North American area codes.
DOMAINS = (
    "com org net edu gov mil int info biz name pro mobi jobs travel museum coop aero io ai app dev cloud online site shop store blog xyz tech club live news email "
    "ac ad ae af ag al am ar as at au az ba bd be bg bh bi bm bn bo br bs bt bw by bz ca cc cd cg ch ci cl cm cn co cr cu cv cy cz de dj dk dm do dz ec ee eg es et eu "
    "fi fj fm fo fr ga ge gg gh gi gl gm gn gp gr gt gu gy hk hn hr ht hu id ie il im in iq ir is it je jm jo jp ke kg kh ki kr kw ky kz la lb li lk ls lt lu lv ly"
)
MORE_DOMAINS = "ma mc md me mg mk ml mm mn mo mr mt mu mv mw mx my mz na ne ng ni nl no np nz om pa pe ph pk pl pr ps pt py qa re ro rs ru rw sa sc se sg si sk sm sn so sr st sv sy sz tc tg th tj tm tn to tr tt tv tw tz ua ug uk us uy uz va ve vg vi vn ws ye za zm zw"
RESERVED = (
    r"0+\.", r"0*10\.", r"0*127\.", r"0*100\.0*(?:6[4-9]|[79][0-9]|8[0-9]|1[01][0-9]|12[0-7])\.", r"0*169\.0*254\.", r"0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.",
    r"0*192\.0*168\.", r"0*192\.0+\.0*[02]\.", r"0*198\.0*1[89]\.", r"0*198\.0*51\.0*100\.", r"0*203\.0+\.0*113\.", r"0*2(?:2[4-9]|[345][0-9])\.",
    "0*:0*:0*:0*:0*:0*:0*:0*1?$", "::1?$", "[Ff][CcDd]", "[Ff][Ee][89ABab]", "[Ff][Ff]", "2001:0*[Dd][Bb]8",
)
ISSUERS = ("4", "5[0-8]", "2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)", "3[47]", "3(?:0[0-5]|[689])", "35(?:2[89]|[3-8])", "6(?:011|4[4-9]|5|2|[37])")
CODES = ("1", "7", "2[07]", "3[0-469]", "4[013-9]", "5[1-8]", "6[0-6]", "8[1246]", "9[0-58]", "(?:2[1-69]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9]")
GAZETTEER = {
    "email": rf"(?i)(?:^|[^A-Za-z0-9-])(?:{'|'.join((DOMAINS + ' ' + MORE_DOMAINS).split())})$",
    "ip": rf"^(?!{'|'.join(RESERVED)})",
    "card": rf"^(?:{'|'.join(ISSUERS)})",
    "phone": rf"^(?:\+|00)[\x20(.-]*(?:{'|'.join(CODES)})|^\(?[2-9](?:[02-9][0-9]|1[02-9])\)?[\x20.-]|^\(?0[1-9]",
}
#: Words in front of a span that speak for its kind, in the languages of the corpus.
FOR = {
    "email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|adresse)",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|anruf|appel|llam)",
}
AGAINST = r"(?i)(?:version|\bv$|order|invoice|isbn|serial|\bid\b|article|section|build|rev)[\x20:#.no]*$"
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before_each(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What all entries before each come to, from 0 on; block by block, so that long arrays cost little more than their length."""
    total = lambda a: F.aggregate(a, F.lit(0), combine)

    def sums(held: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(held, b * BLOCK + 1, F.lit(BLOCK))))
        begins = F.aggregate(blocks, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(combine(F.element_at(a, -1), n))))
        at = lambda begin: F.transform(held, lambda _, i: combine(F.get(begin, F.floor(i / BLOCK).cast("int")), total(F.slice(held, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))
        return let(begins, at)

    return let(values, sums)


def matches(text: Column, pattern: str) -> Column:
    """start, end, value, what stands before (NEAR characters, as far as the match before the last) and the character after of
    all matches, left to right."""
    last = lambda x, n: F.when(F.length(x) > n, F.substring(x, -n, n)).otherwise(x)

    def found(values: Column, gaps: Column) -> Column:
        # A gap and its match, one after another: starts are sums of what came before.
        lengths = F.transform(F.arrays_zip(gaps.alias("g"), values.alias("v")), lambda x: F.struct(F.length(x["g"]).alias("gap"), F.coalesce(F.length(x["v"]), F.lit(0)).alias("own")))
        add = lambda x, y: x + y
        steps = let(lengths, lambda held: F.zip_with(held, before_each(F.transform(held, lambda x: x["gap"] + x["own"]), add), lambda x, before: F.struct((before + x["gap"]).alias("start"), (before + x["gap"] + x["own"]).alias("end"))))

        def span(s: Column, i: Column) -> Column:
            near = lambda x: last(F.coalesce(x, F.lit("")), NEAR)
            before = last(F.concat(near(F.get(gaps, i - 1)), near(F.get(values, i - 1)), near(F.get(gaps, i))), NEAR)
            after = F.substring(F.concat(F.substring(F.get(gaps, i + 1), 1, 1), F.substring(F.coalesce(F.get(values, i + 1), F.lit("")), 1, 1)), 1, 1)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(values, i).alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(F.slice(steps, 1, F.greatest(F.size(values), F.lit(1))), span)

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = let(values, lambda v: let(F.split(text, pattern, -1), lambda g: found(v, g)))
    return F.when(F.rlike(text, F.lit(pattern)), both).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes."""

    def place(padded: Column) -> Column:
        digit = lambda i: F.substring(padded, i, F.lit(1)).cast("int")
        doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, digit(i)).otherwise(doubled(digit(i))))

    return let(F.rpad(F.reverse(number), 19, "0"), place) % 10 == 0


def count_between(value: Column, low: int, high: int, also: Callable[[Column], Column] | None = None) -> Column:
    def checked(number: Column) -> Column:
        right = F.length(number).between(low, high)
        return F.when(right, also(number)).otherwise(False) if also else right

    return let(digits(value), checked)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.rlike(v, F.lit(OCTETS)),
    "card": lambda v: count_between(v, 12, 19, luhn),
    "phone": lambda v: count_between(v, 9, 15),
}
#: Of the card's two forms, the one in base groups is loose for its wrong check digit.
OTHER_GROUPS = "[._/]"
LOOSELY_VALID = VALID | {
    "ip": lambda v: F.contains(v, F.lit(":")) | F.rlike(F.regexp_replace(v, r"[^0-9]+", "."), F.lit(OCTETS)),
    "card": lambda v: F.rlike(v, F.lit(OTHER_GROUPS)) | count_between(v, 13, 19, lambda n: ~luhn(n)),
    "phone": lambda v: count_between(v, 8, 15),
}


def guarded(text: Column, kind: str, which: str, pattern: str, valid: Callable[[Column], Column]) -> Column:
    needed = NEEDS[kind, which]
    there = F.contains(text, F.lit(needed.lstrip("\\"))) if needed in ("@", r"\+") else F.rlike(text, F.lit(needed))
    return F.when(there, F.filter(matches(text, pattern), lambda s: valid(s["value"]))).otherwise(F.array().cast(SPAN))


def blocked(spans: Column) -> Column:
    """Spans of one kind, which follow one another, in blocks: where each begins and ends, and its own."""

    def block(own: Column) -> Column:
        return F.struct(F.get(own, 0)["start"].alias("start"), F.element_at(own, -1)["end"].alias("end"), F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("own"))

    def blocks(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int")), lambda b: let(F.slice(held, b * BLOCK + 1, F.lit(BLOCK)), block))

    return F.when(F.size(spans) > 0, let(spans, blocks)).otherwise(F.array().cast("array<struct<start:int,end:int,own:array<struct<start:int,end:int>>>>"))


def near(s: Column, blocks: Column, margin: int = 0) -> Column:
    """Whether a span lies within margin characters of one of the blocks', 0: whether it overlaps one."""
    close = lambda x: (x["start"] < s["end"] + margin) & (s["start"] < x["end"] + margin)
    return F.exists(blocks, lambda b: close(b) & F.exists(b["own"], close))


def near_any(s: Column, kinds: list[str], margin: int = 0) -> Column:
    found = F.lit(False)
    for k in kinds:
        found = found | near(s, F.col(f"blocks_{k}"), margin)
    return found


def votes(kind: str, base: bool) -> Callable[[Column], Column]:
    """start, end and votes (a base-3 number, one digit for each labeler) of a candidate."""

    def vote(s: Column) -> Column:
        around = F.concat(F.substring(s["before"], -1, 1), F.lit(" "), s["after"])
        in_form = F.lit(1 if base else 0)
        if kind == "card" and not base:
            in_form = F.when(count_between(s["value"], 12, 19, luhn), 1).otherwise(-1)
        cast = [
            in_form,
            F.when(F.rlike(around, F.lit(r"^\w|\w$")), -1).otherwise(0),
            F.when(F.rlike(s["value"], F.lit(GAZETTEER[kind])), int(kind == "email")).otherwise(-1),  # numbers in a range may be anything
            F.when(F.rlike(s["before"], F.lit(FOR[kind])), 1).otherwise(0),
            F.when(F.rlike(s["before"], F.lit(AGAINST)), -1).otherwise(0),
            F.when(near_any(s, [k for k in KINDS if k != kind], NEAR), 1).otherwise(0),
        ]
        number = F.lit(0)
        for v in cast:
            number = number * 3 + (v + 1)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), number.cast("int").alias("votes"))

    return vote


def candidates(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, and for each kind its base spans and its loose ones, with votes; with carry, text and all columns in row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[whole_row(docs)] * carry)
    text = F.col("text")
    held = slim.withColumns({f"found_{k}_{w}": guarded(text, k, w, p[k], v[k]) for w, p, v in (("base", BASE, VALID), ("loose", LOOSE, LOOSELY_VALID)) for k in KINDS})
    held = held.withColumns({f"blocks_{k}": blocked(F.col(f"found_{k}_base")) for k in KINDS})
    columns = {}
    for k in KINDS:
        columns[f"{k}_base"] = F.transform(F.col(f"found_{k}_base"), votes(k, True))
        columns[f"{k}_loose"] = F.transform(F.filter(F.col(f"found_{k}_loose"), lambda s: ~near_any(s, list(KINDS))), votes(k, False))
    return held.select("doc_id", *["text", "row"] * carry, *(c.alias(n) for n, c in columns.items()))


def patterns(table: DataFrame) -> list[tuple[str, int, int]]:
    """kind, votes and count of every vote pattern: 4 * 3^6 rows at most."""
    names = [f"{k}_{w}" for k in KINDS for w in ("base", "loose")]
    of_kind = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["votes"].alias("votes"))
    own = F.flatten(F.array(*(F.transform(F.col(n), of_kind(n.split("_")[0])) for n in names)))
    counts = table.select(F.explode(own).alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    return [(r["kind"], r["votes"], r["n"]) for r in counts.orderBy("kind", "votes").collect()]


def unpacked(number: int) -> list[int]:
    return [number // 3**i % 3 - 1 for i in range(len(LABELERS) - 1, -1, -1)]


def reliabilities(found: list[tuple[str, int, int]], rounds: int = 50) -> tuple[list[float], list[float]]:
    """How often each labeler is right when it votes, and the posterior of each vote pattern, by expectation-maximisation.
    An abstention says nothing. Base spans count as true. As few false candidates may be there to learn from, both classes are taken to be equally
    likely, and reliabilities begin from PRIOR and stay within BOUNDS: no labeler can be turned around."""
    cast = [unpacked(v) for _, v, _ in found]
    right = [PRIOR[0] / sum(PRIOR)] * len(LABELERS)
    post: list[float] = []
    for _ in range(rounds):
        weight = [log(r / (1 - r)) for r in right]
        post = [max(SURE * (c[0] > 0), 1 / (1 + exp(-sum(w * v for w, v in zip(weight, c, strict=True))))) for c in cast]
        for i in range(len(LABELERS)):
            voted = [(n, p if c[i] > 0 else 1 - p) for p, c, (_, _, n) in zip(post, cast, found, strict=True) if c[i]]
            share = (PRIOR[0] + sum(n * p for n, p in voted)) / (sum(PRIOR) + sum(n for n, _ in voted))
            right[i] = min(BOUNDS[1], max(BOUNDS[0], share))
    return right, post


def features(cast: list[int]) -> list[float]:
    return [1.0, *(float(v == 1) for v in cast), *(float(v == -1) for v in cast)]


def classifier(found: list[tuple[str, int, int]], rounds: int = 400) -> list[float]:
    """Weights of a logistic regression on votes, fitted to the posteriors; patterns weigh in by the logarithm of their count."""
    rows = [(features(unpacked(v)), p, log(1 + n)) for (_, v, n), p in zip(found, reliabilities(found)[1], strict=True)]
    total = sum(n for _, _, n in rows) or 1.0
    w = [0.0] * len(features([0] * len(LABELERS)))
    for _ in range(rounds):
        slope = [0.002 * x for x in w]
        for x, p, n in rows:
            off = 1 / (1 + exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - p
            for i, v in enumerate(x):
                slope[i] += n * off * v / total
        w = [a - 1.0 * b for a, b in zip(w, slope, strict=True)]
    return w


def accepted(weights: list[float]) -> Callable[[Column], Column]:
    limit = log(ACCEPT / (1 - ACCEPT))

    def test(s: Column) -> Column:
        total = F.lit(weights[0])
        for i in range(len(LABELERS)):
            vote = F.floor(s["votes"] / 3 ** (len(LABELERS) - 1 - i)) % 3
            total = total + F.when(vote == 2, weights[1 + i]).when(vote == 0, weights[1 + len(LABELERS) + i]).otherwise(0.0)
        return total >= limit

    return test


def named(column: Column, kind: str) -> Column:
    return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end), kind a number in KINDS, in order."""
    table = written(candidates(docs), "pii-candidates")
    return decided(table, classifier(patterns(table)))


def decided(table: DataFrame, weights: list[float]) -> DataFrame:
    """Keep the classifier's spans. table: candidates with any columns more."""
    base = F.array_sort(F.concat(*(named(F.col(f"{k}_base"), k) for k in KINDS)))
    loose = F.concat(*(named(F.filter(F.col(f"{k}_loose"), accepted(weights)), k) for k in KINDS))
    held = table.withColumns({"base": base, "added": loose}).drop(*(f"{k}_{w}" for k in KINDS for w in ("base", "loose")))
    return held.withColumn("spans", F.array_sort(F.concat("base", "added"))).drop("added")


def masked(text: Column, spans: Column) -> Column:
    """text with a tag in place of each span; of spans that overlap, the first names them all."""
    tags = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    chunk = lambda n: F.floor(n / CHUNK).cast("int")

    def parts(held: Column, chunks: Column, done: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            own = lambda n: F.get(chunks, chunk(n))
            several = F.concat(F.substring(own(a), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, chunk(a) + 2, chunk(b) - chunk(a) - 1), ""), F.substring(own(b), F.lit(1), b % CHUNK))
            return F.when(chunk(a) == chunk(b), F.substring(own(a), a % CHUNK + 1, b - a)).otherwise(several)

        cut = F.zip_with(held, done, lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.get(tags, s["kind"]))).otherwise(F.lit("")))
        rest = F.greatest(F.element_at(held, -1)["end"], F.element_at(done, -1))
        return F.concat(F.array_join(cut, ""), piece(rest, F.length(text)))

    chunks = F.transform(F.sequence(F.lit(0), chunk(F.length(text))), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))
    done = lambda held: before_each(F.transform(held, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    whole = let(spans, lambda held: let(chunks, lambda c: let(done(held), lambda d: parts(held, c, d))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, all other columns as they were; a null text stays null."""
    weights = classifier(patterns(written(candidates(docs), "pii-candidates")))
    found = decided(candidates(docs, carry=True), weights)
    text = F.when(F.col("row")["text"].isNotNull(), masked(F.col("text"), F.col("spans")))
    return unpacked_rows(found, text=text)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(documents(spark, sf_dir))
    is_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op6_pii": op6_pii}
SQL: dict[str, str] = {}
