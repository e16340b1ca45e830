"""Fields of archive API replies, whose values may be a string, a list or missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_else, strip


def parse(json: Column) -> Column:
    return F.try_parse_json(json)


def _string(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _array(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _is_list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def first_of(v: Column, path: str) -> Column:
    """A scalar as it is, a list's first element; null if missing or empty."""
    return F.when(_is_list(v, path), _string(v, path + "[0]")).otherwise(_string(v, path))


def document_type(v: Column) -> Column:
    """From type, original format or genre, else from words of the title."""
    listed = lambda p: F.when(_is_list(v, p), _string(v, p + "[0]"))
    title = F.lower(_string(v, "$.item.title"))
    has = lambda w: F.coalesce(F.contains(title, F.lit(w)), F.lit(False))
    by_title = F.when(has("letter"), "Letter").when(has("speech") | has("address") | has("inaugural"), "Speech").otherwise("Document")
    return F.coalesce(first_of(v, "$.item.type"), listed("$.item.original_format"), listed("$.item.genre"), by_title)


def metadata(v: Column) -> Column:
    """struct<title, date, from, to, place> of an item."""
    title = F.coalesce(_string(v, "$.item.title"), F.lit("Unknown"))
    contributor = _string(v, "$.item.contributor_names[0]")
    halves = F.split(title, " to ", -1)
    addressed = F.contains(F.lower(title), F.lit(" to ")) & (F.size(halves) > 1)
    sender = F.when(addressed & F.contains(F.get(halves, F.lit(0)), F.lit("Abraham Lincoln")), "Abraham Lincoln").otherwise(contributor)
    recipient = F.when(addressed, strip(F.split_part(F.get(halves, F.lit(1)), F.lit(","), F.lit(1))))
    return F.struct(
        title.alias("title"),
        first_of(v, "$.item.date").alias("date"),
        sender.alias("from"),
        recipient.alias("to"),
        first_of(v, "$.item.location").alias("place"),
    )


def _files(resource: Column) -> Column:
    groups = F.filter(_array(resource, "$.files"), lambda g: _is_list(g, "$"))
    return F.flatten(F.transform(groups, lambda g: _array(g, "$")))


def pdf_url(v: Column) -> Column:
    """Of the resources in order, the PDF itself or the first file whose URL names one; else the resource's PDF."""
    each = F.transform(
        _array(v, "$.resources"),
        lambda r: F.coalesce(
            _string(r, "$.pdf"),
            F.get(F.filter(F.transform(_files(r), lambda f: _string(f, "$.url")), lambda u: F.contains(F.lower(u), F.lit(".pdf"))), F.lit(0)),
        ),
    )
    return F.coalesce(F.get(F.filter(each, lambda u: u.isNotNull()), F.lit(0)), _string(v, "$.resource.pdf"))


def image_urls(v: Column) -> Column:
    """URLs of all image files, by media type or ending, then the resource's image."""
    files = F.flatten(F.transform(_array(v, "$.resources"), _files))
    image = lambda f: F.coalesce(F.contains(_string(f, "$.mimetype"), F.lit("image")), F.lit(False)) | F.coalesce(
        F.rlike(_string(f, "$.url"), F.lit(r"\.(jpg|jpeg|tif|tiff)\z")), F.lit(False)
    )
    own = _string(v, "$.resource.image")
    return F.array_compact(F.concat(F.transform(F.filter(files, image), lambda f: F.coalesce(_string(f, "$.url"), F.lit(""))), F.array(own)))


def fulltext_url(v: Column) -> Column:
    each = F.filter(F.transform(_array(v, "$.resources"), lambda r: _string(r, "$.fulltext_file")), lambda u: u.isNotNull())
    return F.coalesce(F.get(each, F.lit(0)), _string(v, "$.resource.fulltext_file"))


def book_text_url(formats: Column) -> Column:
    """From an ordered array of struct<type, url>: the first UTF-8 plain text, else the first plain text."""
    plain = F.filter(formats, lambda f: F.contains(f["type"], F.lit("text/plain")))
    utf8 = F.filter(plain, lambda f: F.contains(f["type"], F.lit("utf-8")))
    return F.coalesce(F.get(utf8, F.lit(0))["url"], F.get(plain, F.lit(0))["url"])


def authors(names: Column) -> Column:
    """Names of an array of struct<name>, joined."""
    return F.array_join(F.transform(names, lambda a: a["name"]), ", ")


def title_or_id(title: Column, doc_id: Column) -> Column:
    return or_else(title, doc_id)
