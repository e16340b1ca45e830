"""REST sources as Python data sources: one partition for each host, paced within it.

Replies come from ``fetcher``, a picklable callable from URL to text, so tests and offline runs use
stored replies (``StoredReplies``). Options: ``urls`` (newline-separated), ``pause`` (seconds).
"""

from __future__ import annotations

import json
import time
from collections import defaultdict
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class StoredReplies:
    """Replies by URL; others fail."""

    replies: dict[str, str]

    def __call__(self, url: str) -> str:
        return self.replies[url]


@dataclass
class HttpGet:
    timeout: float = 60.0

    def __call__(self, url: str) -> str:
        with urlopen(url, timeout=self.timeout) as r:
            return r.read().decode("utf-8", "replace")


@dataclass
class HostUrls(InputPartition):
    host: str
    urls: list[str]


_REPLY = T.StructType().add("url", T.StringType()).add("body", T.StringType()).add("error", T.StringType())


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], pause: float, fetcher):
        self._urls, self._pause, self._fetcher = urls, pause, fetcher

    def partitions(self):
        hosts: dict[str, list[str]] = defaultdict(list)
        for u in self._urls:
            hosts[urlsplit(u).netloc].append(u)
        return [HostUrls(h, us) for h, us in hosts.items()]

    def read(self, partition: HostUrls):
        for i, url in enumerate(partition.urls):
            if i and self._pause:
                time.sleep(self._pause)
            try:
                yield (url, self._fetcher(url), None)
            except Exception as e:  # a reply that fails is a row with its error
                yield (url, None, f"{type(e).__name__}: {e}")


def _source(fetcher):
    class WebReplies(DataSource):
        @classmethod
        def name(cls):
            return "web_replies"

        def schema(self):
            return _REPLY

        def reader(self, schema):
            return _Reader(json.loads(self.options["urls"]), float(self.options.get("pause", "0")), fetcher)

    return WebReplies


def fetch(spark: SparkSession, urls: list[str], fetcher=None, pause: float = 0.0) -> DataFrame:
    """(url, body, error) of each URL, in turn within a host."""
    spark.dataSource.register(_source(fetcher or HttpGet()))
    return spark.read.format("web_replies").option("urls", json.dumps(urls)).option("pause", str(pause)).load()


def archive_items(spark: SparkSession, urls: list[str], fetcher=None, pause: float = 3.5) -> DataFrame:
    """(url, url_type, id, payload, title, document_type, date, place, from, to, files...) of archive
    items from their JSON replies; an item whose reply fails is a stub titled by its id."""
    asked = [u.rstrip("/") + "/?fo=json" for u in urls]
    return items_of(fetch(spark, asked, fetcher, pause).withColumn("url", F.regexp_replace("url", r"/\?fo=json\z", "")))


def items_of(replies: DataFrame) -> DataFrame:
    """Fields of archive items from their replies (url, body, error)."""
    from ..functions import payload
    from ..functions.links import archive_id, url_type
    from ..functions.text import or_else

    v = payload.parse(F.col("body"))
    rows = replies.select(F.col("url"), url_type(F.col("url")).alias("url_type"), archive_id(F.col("url")).alias("id"), v.alias("v"), "error")
    m = payload.metadata(F.col("v"))
    ok = F.col("v").isNotNull()
    rows = rows.withColumn("m", F.when(ok, m)).withColumn("document_type", F.when(ok, payload.document_type(F.col("v"))))
    return rows.select(
        "url", "url_type", "id", or_else(F.col("m.title"), F.col("id")).alias("title"), F.coalesce("document_type", F.lit("Document")).alias("document_type"),
        "m.date", "m.place", "m.from", "m.to", payload.pdf_url(F.col("v")).alias("pdf_url"), payload.image_urls(F.col("v")).alias("image_urls"),
        payload.fulltext_url(F.col("v")).alias("fulltext_url"), "error",
    )


def books(spark: SparkSession, ids: list[int], base: str, fetcher=None) -> DataFrame:
    """(id, title, authors, text_url) of books from one reply about all ids."""
    return books_of(fetch(spark, [books_url(ids, base)], fetcher))


def books_url(ids: list[int], base: str) -> str:
    return f"{base}?ids={','.join(map(str, ids))}"


def books_of(replies: DataFrame) -> DataFrame:
    """Fields of books from replies (url, body, error) that list them under ``results``."""
    from ..functions import payload

    v = payload.parse(F.col("body"))
    result = F.explode(F.try_variant_get(v, "$.results", "array<variant>")).alias("b")
    rows = replies.filter("body IS NOT NULL").select(result)
    get = lambda p, t: F.try_variant_get(F.col("b"), p, t)
    formats = F.transform(F.map_entries(get("$.formats", "map<string,string>")), lambda e: F.struct(e["key"].alias("type"), e["value"].alias("url")))
    return rows.select(
        get("$.id", "int").alias("id"), get("$.title", "string").alias("title"),
        payload.authors(get("$.authors", "array<struct<name:string>>")).alias("authors"), payload.book_text_url(formats).alias("text_url"),
    )
