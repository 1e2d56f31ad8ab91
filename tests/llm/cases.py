"""Documents that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `key` string, `a.b` int"
SMALL = "/root/testdata/sf0.001"


def texts(n: int = 60) -> list[tuple]:
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text", "lang"]).slice(0, n)
    return list(zip(*(table[c].to_pylist() for c in ("doc_id", "text", "lang")), strict=True))


def odd() -> list[tuple]:
    """doc_id, text, lang."""
    words = random.Random(3)
    long = " ".join(words.choice(["ab", "abc", "é", "Zz", "1.2.3.4", "x"]) for _ in range(40_000))
    return [
        (1000, None, None), (1001, "", "en"), (1002, "   \n\t ", "en"), (1003, "one", ""), (1004, "two words", "de"), (1005, long, "en"),
        (1006, "a" * 30_000, "en"), (None, "no id here at all", "en"), (1007, "the same text again", "en"), (1008, "the same text again", "fr"),
        (1009, "repeated row", "en"), (1009, "repeated row", "en"), (1010, "Ωμέγα 日本語 ▁   🙂 <|endoftext|>", None), (1011, "mail me: jo.do@ex.org", "en"),
    ]


def long() -> list[tuple]:
    """Texts of about a million characters that are hard on searches, sorts and matchers."""
    return [
        (3000, " " * 1_000_000, "en"), (3001, "a" * 1_000_000, "en"), (3002, "\n " * 500_000, "en"),
        (3003, "The same line stands here again and again, for a million characters.\n" * 14_500, "en"),
        (3004, "ann@ex.org 10.1.2.3 " * 25_000, "en"),
    ]


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(d, t, lang, None, None if t is None else len(t), "r", "k", 1) for d, t, lang in rows], SCHEMA).repartition(3)


def folder(spark, path, rows: list[tuple], labels: list[tuple] | None = None) -> str:
    """A table folder with documents (and labels)."""
    frame(spark, rows).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    if labels is not None:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return str(path)
