"""Names made from URLs, titles and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip


def url_type(url: Column) -> Column:
    return (
        F.when(F.contains(url, F.lit("/item/")), "item")
        .when(F.contains(url, F.lit("/resource/")), "resource")
        .when(F.contains(url, F.lit("/exhibits/")), "exhibits")
        .otherwise("unknown")
    )


def _after_last(url: Column, mark: str) -> Column:
    return F.split_part(F.element_at(F.split(url, mark, -1), -1), F.lit("/"), F.lit(1))


def archive_id(url: Column) -> Column:
    """The id part of an item, resource or exhibit URL; ``unknown`` for others."""
    url = F.rtrim(url, F.lit("/"))
    kind = url_type(url)
    return (
        F.when(kind == "item", _after_last(url, "/item/"))
        .when(kind == "resource", F.replace(_after_last(url, "/resource/"), F.lit("."), F.lit("_")))
        .when(kind == "exhibits", F.concat(F.lit("exhibits_"), F.replace(F.element_at(F.split(url, "/", -1), -1), F.lit(".html"), F.lit(""))))
        .otherwise("unknown")
    )


def safe_filename(text: Column, length: int = 50) -> Column:
    """Letters, digits, spaces, hyphens and underscores of a title, spaces as underscores, cut at ``length``."""
    return F.substring(F.replace(strip(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", "")), F.lit(" "), F.lit("_")), 1, length)


def event_slug(event: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(event), rf"(?U)[^\w\s\x1c-\x1f-]", ""), f"(?U){WS}+", "_")


def event_filename(doc_id: Column, event: Column) -> Column:
    return F.concat(doc_id, F.lit("_"), event_slug(event), F.lit(".md"))


def image_extension(url: Column) -> Column:
    return F.when(F.contains(F.lower(url), F.lit(".jpg")), ".jpg").otherwise(".tif")


def shown(text: Column, length: int = 30) -> Column:
    """A title for a report: cut at ``length`` and marked where it was longer."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
