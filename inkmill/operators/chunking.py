"""Overlapping spans of long texts that end at paragraphs or sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.tokens import CHARS_PER_TOKEN

#: Characters of a retrieval chunk and of a model batch, and what the next one repeats.
CHUNK_CHARS, CHUNK_OVERLAP = 1000 * CHARS_PER_TOKEN, 200 * CHARS_PER_TOKEN
BATCH_CHARS, BATCH_OVERLAP = 30_000 * CHARS_PER_TOKEN, 1000 * CHARS_PER_TOKEN


def _last(window: Column, mark: str) -> Column:
    """Where the last ``mark`` ends in ``window``; null if it has none."""
    at = F.locate(mark[::-1], F.reverse(window))
    return F.when(at > 0, F.length(window) - at + 1)


def spans(content: Column, size: int, overlap: int) -> Column:
    """array<struct<start, end>>, from 0; the last end is not cut to the text's length.

    Each span looks for its end in its last ``overlap`` characters, so it advances by at least
    ``size`` - 2 * ``overlap`` + 2, which bounds the number of steps.
    """
    if overlap * 2 > size:
        raise ValueError("the overlap is at most half of the size")
    n = F.length(content)
    span = "struct<start:int,end:int>"

    def step(acc: Column, _: Column) -> Column:
        start, full = acc["at"], acc["at"] + size
        window = F.substring(content, start + (size - overlap + 1), F.lit(overlap))
        found = start + (size - overlap) + F.coalesce(_last(window, "\n\n"), _last(window, ". "))
        end = F.when(full < n, F.coalesce(found, full)).otherwise(full)
        more = F.struct(
            F.when(end - overlap < n - overlap, end - overlap).otherwise(n).alias("at"),
            F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"),
        )
        return F.when(start < n, more).otherwise(acc)

    steps = F.sequence(F.lit(0), F.floor(n / (size - 2 * overlap + 2)).cast("int") + 1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))
    return F.aggregate(steps, begin, step, lambda acc: acc["out"])


def split(docs: DataFrame, size: int, overlap: int, number: str, first: int = 0, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, ``number``, text, start_char, end_char) of the spans that are not blank, numbered from
    ``first``. Null and empty texts have none. Row-local: no shuffle."""
    text = F.col(content)
    cut = F.transform(
        spans(text, size, overlap),
        lambda s: F.struct(strip(F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("text"), s["start"].alias("start_char"), s["end"].alias("end_char")),
    )
    kept = F.filter(F.when(text != "", cut), lambda s: s["text"] != "")
    rows = docs.select(F.col(doc_id), F.posexplode(kept).alias("_n", "_s"))
    return rows.select(doc_id, (F.col("_n") + first).alias(number), "_s.text", "_s.start_char", "_s.end_char")


def chunk_documents(docs: DataFrame, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, **columns) -> DataFrame:
    return split(docs, size, overlap, "chunk_id", 0, **columns)


def batch_documents(docs: DataFrame, size: int = BATCH_CHARS, overlap: int = BATCH_OVERLAP, **columns) -> DataFrame:
    return split(docs, size, overlap, "batch_num", 1, **columns)
