"""Rows that every operator must take: nulls, empty and very long texts, ties, clashing names."""

from __future__ import annotations

import random

WORDS = "the of tion ing ea on re er tha nd lorem grüße niño état 漢字".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n))


LONG = prose(1, 40_000)
ODD = [
    (1, "Alpha beta gamma"), (2, "alpha BETA gamma"), (3, None), (4, ""), (None, "no id at all"), (None, "no id at all"),
    (5, prose(5, 300)), (6, prose(5, 300) + " extra"), (7, prose(7, 300)), (7, prose(7, 300)), (8, LONG), (9, LONG.upper()),
    (10, " \t\n "), (11, "É é"), (12, "é é"), (13, "a\0b\x1c c"), (14, "line one\n" * 40), (15, prose(15, 80)),
]
CLASH = ("key", "kept", "text_sha256", "owner", "fingerprint", "t1", "t2", "spans", "ids", "part", "left", "line", "words",
         "bucket", "score", "label", "component_id", "n_chars", "__turn")


def odd_docs(spark, clashing: bool = True):
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'en' AS lang", "CAST(NULL AS STRING) AS source")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASH]) if clashing else df


def no_docs(spark):
    return odd_docs(spark).limit(0)


def table(spark, name: str, folder: str = "sf0.001"):
    return spark.read.parquet(f"/root/testdata/{folder}/{name}.parquet")
