"""Rows that every corpus operator must take: nulls everywhere, empty and long texts, ties, repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = " ".join(f"w{k % 977} x{k % 31}" for k in range(20_000))
TWICE = "the same line stands here more than once\nand another one that differs, well enough"
CASES = [
    (1, TWICE, "en", "a", 10),
    (1, TWICE, "en", "a", 10),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "no id here but a text of some length anyway", "en", None, 5),
    (None, None, None, None, None),
    (4, LONG, "en", "b", len(LONG)),
    (5, TWICE + "\nmore", "de", "\U0001f600", 12),
    (6, " \t\n\x0b\x0c\r ", "fr", "", 7),
    (7, "퟿é\U0001f600 mots été\n\n\n", "fr", "b", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("_doc", "_th", "_at", "_row", "_id", "_text", "_n", "_n_dropped", "_kept", "doc", "th", "node", "n", "y", "size", "epoch", "taken", "key", "a", "b")


def clashing(docs: DataFrame) -> DataFrame:
    """``docs`` with more columns, named as the operators name theirs."""
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)])
