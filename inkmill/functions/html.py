"""HTML and XML to text. The parser is Python's; rows go through it in Arrow batches."""

from __future__ import annotations

import html as _html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import release
from .text import WS, fix_encoding, strip

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "blockquote", "pre"}


class _Page(HTMLParser):
    """Collects headings and text blocks, each with the container kinds it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str]]] = []
        self.seen: set[str] = set()
        self.first: dict[str, list[str] | None] = {"h1": None, "title": None}
        self.blocks: list[tuple[frozenset, list[str]]] = []
        self.sinks: list[tuple[int, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        kinds = set()
        a = dict(attrs)
        if tag == "div" and "content" in (a.get("class") or "").split():
            kinds.add("class")
        if tag == "div" and a.get("id") == "content":
            kinds.add("id")
        if tag in ("article", "main", "body"):
            kinds.add(tag)
        kinds -= self.seen  # only the first container of a kind counts
        self.seen |= kinds
        if tag in _VOID:
            return
        self.open.append((tag, kinds))
        if tag in self.first and self.first[tag] is None:
            self.first[tag] = []
            self.sinks.append((len(self.open), self.first[tag]))
        if tag in _BLOCKS:
            text: list[str] = []
            self.blocks.append((frozenset(k for _, ks in self.open for k in ks), text))
            self.sinks.append((len(self.open), text))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
            self.sinks = [s for s in self.sinks if s[0] <= len(self.open)]

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        for _, text in self.sinks:
            text.append(data.strip())

    def result(self) -> tuple[str, str]:
        heading = self.first["h1"] if self.first["h1"] is not None else self.first["title"]
        kind = next((k for k in ("class", "id", "article", "main", "body") if k in self.seen), None)
        texts = ["".join(t) for kinds, t in self.blocks if kind in kinds]
        return "".join(heading or []), "\n\n".join(t for t in texts if t)


_PAGE = T.StructType().add("title", T.StringType()).add("content", T.StringType())


@F.pandas_udf(_PAGE)
def page_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Heading and text blocks of the main container; null pages give nulls, broken markup what can be read."""
    for pages in batches:
        out = []
        for page in pages:
            if page is None:
                out.append((None, None))
                continue
            p = _Page()
            p.feed(page)
            p.close()
            out.append(p.result())
        yield pd.DataFrame(out, columns=["title", "content"])
        del pages, out
        release()


@F.pandas_udf(T.StringType())
def unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(_html.unescape, na_action="ignore")
        del texts
        release()


def xml_text(xml: Column) -> Column:
    """Text without tags, entities decoded, white space collapsed."""
    return strip(F.regexp_replace(unescape(F.regexp_replace(xml, "<[^>]+>", " ")), f"(?U){WS}+", " "))


def clean_xml_text(xml: Column) -> Column:
    return fix_encoding(xml_text(xml))


def fulltext(url: Column, body: Column) -> Column:
    """A fetched transcription: markup is removed where the URL or the first characters show it."""
    marked = F.endswith(url, F.lit(".xml")) | F.contains(F.substring(body, 1, 100), F.lit("<"))
    return F.when(marked, xml_text(body)).otherwise(body)
