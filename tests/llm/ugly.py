"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, columns named like results."""

from pyspark.sql import functions as F

LONG = " ".join(f"wort{i % 977}{chr(97 + i % 26)}" for i in range(30000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all day long"), (2, None), (3, ""), (4, " \t\n\x0b\r "), (5, "one"),
    (6, "one two"), (7, LONG), (8, "The quick brown fox jumps over the lazy dog and runs away from it all day long"),
    (8, "The quick brown fox jumps over the lazy dog and runs away from it all day long"), (None, "no id here but some words to read"),
    (None, None), (9, "\x00 odd\x1f bytes   　 \U0001f600 ́ é <|endoftext|>"), (10, "x" * 5000), (11, "!!! ??? ***"),
    (-4, "une phrase entière en français, où l'on répète une phrase entière"),
]
CLASH = ("score", "length", "id", "size", "copies", "component_id", "start", "key", "label", "n")


def documents(spark, rows=TEXTS, clash=CLASH):
    frame = spark.createDataFrame([(*r, f"s{i % 3}" if i % 5 else None) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    return frame.withColumns({c: F.lit(None).cast("string") for c in clash})


def nothing(spark):
    return documents(spark).where("false")
