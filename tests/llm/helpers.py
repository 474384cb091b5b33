"""Rows that every document operator must stand, and small readers."""

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SMALL = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def words(text, lower=False):
    return WORD.findall(lowered(text or "") if lower else text or "")


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names operators use inside."""
    long_text = " ".join(f"wort{i % 977}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from all of them today", "en", "a", 10, 7, "x"),
        (1, "The quick brown fox jumps over the lazy dog and runs away from all of them today", "en", "a", 10, 7, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 1, ""),
        (4, " \t\n ", "de", None, 4, 1, "y"),
        (None, "The quick brown fox jumps over the lazy dog and runs away from all of them today", "en", "a", 10, 7, "x"),
        (5, long_text, "de", "b", len(long_text), 2, "z"),
        (6, "1234 5678 !!! ---", None, "b", 17, 2, "z"),
        (7, "word", "fr", "b", 4, 2, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, pos string")


def empty(df):
    return df.limit(0)
