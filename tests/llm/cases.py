"""Small documents with the odd cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "the quick brown fox jumps over the lazy dog while seven small boats drift along a quiet river under pale morning light and nobody on the shore says a word about it"
LONG = " ".join(f"word{i % 977} of {i}" for i in range(20_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS: list[tuple[int | None, str | None, str | None, str | None]] = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, None),
    (4, BASE, "en", "a"),
    (5, BASE, "en", "b"),
    (6, BASE.upper(), "en", "b"),
    (7, BASE.replace("pale", "cold"), "de", "b"),
    (7, BASE.replace("pale", "cold"), "de", "b"),
    (8, LONG, "de", "a"),
    (9, LONG + " tail", "de", "a"),
    (10, "one two three", None, "a"),
    (11, "One Two  Three", "fr", "a"),
    (12, "the cat sat on the mat again " * 30, "en", "c"),
    (13, f"alpha {PASSAGE} omega", "en", "a"),
    (14, f"beta {PASSAGE} gamma {PASSAGE}", "en", "a"),
    (15, "Ärger über 漢字 und 🙂 mail a.b@c-d.org now here \x1c   x", "de", "b"),
    (16, "call +49 (30) 1234-5678 or +1 2 or 4111 1111 1111 1111, 10.0.0.256 10.0.0.25 010.1.1.1.1", "en", "b"),
    (17, "a@b@c.d.e x@y..z 1@2.3 4111111111111112 4012888888881881 me at home dot org 555-123-4567", "en", "b"),
    (18, "<|endoftext|> <s> ▁ text  with   runs \n\n of white space ", "en", "a"),
    (19, "x" * 300_000, "en", "a"),
    (20, "line one\nline one\nline two\n\nline one", "en", None),
    (21, "1" * 5000, None, "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark: SparkSession, rows=ROWS) -> DataFrame:
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA + ", n_chars long")


#: Names that the operators use for their own columns.
CLASHES = ["key", "n", "token", "slot", "component", "pii", "n_words", "_words", "mix_slot", "_mark", "mark", "symbol", "shard", "size", "law", "kept", "start", "length", "fingerprint", "bucket_offset"]


def clashing(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    return documents(spark).select("*", *[F.lit("other").alias(c) for c in CLASHES])
