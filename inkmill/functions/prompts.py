"""Prompts and replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACE = re.compile(r"\{(\w+)\}|(\{\{)|(\}\})")


def render(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled, ``{{`` and ``}}`` standing for braces.

    The template is cut at its places, so braces within values are left alone; a null value shows
    as ``None``.
    """
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        parts.append(F.lit("{") if m[2] else F.lit("}") if m[3] else F.coalesce(values[m[1]].cast("string"), F.lit("None")))
    return F.concat(*parts, F.lit(template[at:]))


def bullets(items: Column) -> Column:
    """``- item`` lines of an array, null items left out."""
    return F.array_join(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.concat(F.lit("- "), x)), "\n")


def passages(texts: Column, length: int = 2000) -> Column:
    """Numbered passages of an ordered array of texts, each cut at ``length``."""
    numbered = F.transform(
        texts, lambda t, i: F.concat(F.lit("[Passage "), (i + 1).cast("string"), F.lit("]:\n"), F.substring(t, 1, length))
    )
    return F.array_join(numbered, "\n\n")


def event_query(event: Column) -> Column:
    # Fixed value: the words that are added to an event's name for retrieval.
    return F.concat(event, F.lit(" Abraham Lincoln historical event"))


def doc_info(title: Column, doc_id: Column) -> Column:
    return F.concat(title, F.lit(" ("), doc_id, F.lit(")"))


def reply_array(reply: Column, most: int = 5) -> Column:
    """The first bracketed list of strings in a reply, at most ``most`` of it; null if it cannot be read."""
    found = F.nullif(F.regexp_extract(reply, r"(?s)\[.*?\]", 0), F.lit(""))
    return F.slice(F.from_json(found, "array<string>"), 1, most)
