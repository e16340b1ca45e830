"""Words and size estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that stand for one token.
CHARS_PER_TOKEN = 4


def tokenize(text: Column) -> Column:
    """Lower-cased runs of word characters that are made of a-z and 0-9 only."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z0-9]+\b"), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("long")


def estimate_chars(tokens: Column) -> Column:
    return tokens * CHARS_PER_TOKEN
