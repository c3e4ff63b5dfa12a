"""Rows with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs along the river until it finds a quiet place to sleep"
    rows = [
        (0, None, "en", "a", 0), (1, "", "en", None, 0), (2, " \t\n\r\x0b\x0c ", None, "b", 6), (3, base, "en", "a", 1), (4, base.upper(), "en", "b", 1), (4, base.upper(), "en", "b", 1),
        (None, base + " deep", "de", "a", 2), (6, "été à la plage, où naïve coïncide 東京 🎉", "fr", None, 3), (7, "word " * 60_000, "en", "z", 300_000), (8, "x" * 200_000, None, "a", 1),
        (9, "<|endoftext|> <|startoftext|> a\u00a0b \u2003c\x1cd", "en", "b", 1), (10, "!!! ??? 123", "en", "é", 1), (11, base + " deep", None, None, None), (12, "one", "de", "a", 1), (13, "ONE", "de", "a", 1),
    ]
    clash = [r + ("hit", 1, "x", "y") for r in rows]
    return spark.createDataFrame(clash, "doc_id bigint, text string, lang string, source string, n_chars bigint, hits string, bits int, spans string, language string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def items(spark):
    rows = [(1, "quick brown fox jumps over the lazy dog and runs along the river"), (2, "a quiet place"), (2, "a quiet place"), (None, "brown fox"), (3, None), (4, " .,; "), (5, "Fox Jumps over the lazy dog and runs along the river until it stops"), (6, "東京"), (7, "the river until it finds a quiet place to sleep")]
    return spark.createDataFrame(rows, "item_id bigint, text string")
