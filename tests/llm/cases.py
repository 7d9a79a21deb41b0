"""Rows with nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""

from pyspark.sql import types as T

NAMES = ("doc_id", "text", "lang", "source", "n_chars")
# columns of users that have the names the operators use inside
CLASHES = ("hash", "norm", "node", "key", "tag", "bucket", "kept", "component", "digest", "kept_id", "dropped_id", "n",
           "text_tag", "length", "task")
PROSE = "the quick brown fox jumps over the lazy dog while many others look on and wonder about the night "


def long_text(words: int) -> str:
    return " ".join(f"w{(i * 7919) % 10007}x{i % 13}" for i in range(words))


def documents(spark, clashes: bool = True):
    rows = [
        (1, PROSE * 3, "en", "a", 10),
        (2, (PROSE * 3).upper(), "en", "a", None),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, long_text(6000), "en", "b", 5),
        (6, long_text(6000) + " tail", "en", None, 5),
        (6, long_text(6000) + " tail", "en", None, 5),
        (None, "Released under the MIT License. " + PROSE, "en", "c", 1),
        (8, "ÉCOLE É́cole <|endoftext|> 日本 <|im_start|> %25 %", "fr", "c", 1),
        (9, "ab" * 3000, "xx", "d", 1),
        (10, "one two three", "en", "d", 1),
        (11, "One TWO three", "en", "d", 1),
        (12, "a b\n" * 40, "en", "d", 1),
        (13, " \t\n", "en", "d", 1),
        (2**40, long_text(900) + " x " + PROSE * 6, "en", "e", 1),
        (2**40 + 1, PROSE * 6 + " y " + long_text(300), "en", "e", 1),
    ]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType()]
    fields = [T.StructField(n, k) for n, k in zip(NAMES, kinds)]
    if clashes:
        fields += [T.StructField(c, T.StringType()) for c in CLASHES]
        rows = [r + tuple(f"{c}!" for c in CLASHES) for r in rows]
    return spark.createDataFrame(rows, T.StructType(fields))


def empty(spark):
    return documents(spark).limit(0)


def ascii_fold(text: str) -> str:
    return text.encode().lower().decode()
