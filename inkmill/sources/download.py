"""Downloads that can be stopped and resumed, and raw files written by tasks.

Bodies are bytes in a committed table by URL. URLs that it has no body for are fetched in waves, each committed
before the next begins; those that failed are fetched again by the next call. All URLs of a host are in one
task, which waits between two requests; hosts go side by side.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_folder
from .committed import CommittedTable


@dataclass
class HttpBytes:
    timeout: float = 60.0

    def __call__(self, url: str) -> bytes:
        with urlopen(url, timeout=self.timeout) as r:
            return r.read()


class Downloads:
    """Bodies under ``path``. ``fetcher``: a picklable callable from URL to bytes (or text); ``pause``: seconds between
    two requests to one host; ``wave``: URLs between two commits."""

    def __init__(self, spark: SparkSession, path: str, fetcher: Callable[[str], bytes | str] | None = None, pause: float = 0.0, wave: int = 1000):
        self.spark, self.fetcher, self.pause, self.wave = spark, fetcher or HttpBytes(), pause, wave
        self.table = CommittedTable(spark, path, "url string, body binary, error string")

    def known(self) -> DataFrame:
        """(url, body), one row for each URL that was fetched."""
        return self.table.read().filter(F.col("body").isNotNull()).dropDuplicates(["url"]).select("url", "body")

    def get(self, urls: DataFrame) -> DataFrame:
        """(url, body, error) of each distinct URL of a frame with ``url``; nulls are left out."""
        folder = new_folder(self.spark, "urls")
        urls.select("url").filter(F.col("url").isNotNull()).distinct().write.parquet(folder)
        wanted = self.spark.read.parquet(folder)
        rest = wanted.join(self.known().select("url"), "url", "left_anti")
        n, tried = rest.count(), []
        waves = -(-n // self.wave)
        if n:
            pending = new_folder(self.spark, "pending")
            rest.withColumn("wave", F.pmod(F.xxhash64("url"), F.lit(waves)).cast("int")).write.parquet(pending)
            for w in range(waves):
                part = self.table.write_part(self._fetched(self.spark.read.parquet(pending).filter(F.col("wave") == w).select("url")))
                while part["rows"] and not self.table.commit(base := self.table.snapshot(), [*base.parts, part]):
                    pass
                tried.append(part)
        failed = self.table._read(tried).filter(F.col("error").isNotNull()).select("url", "error")
        out = wanted.join(self.known(), "url", "left").join(failed, "url", "left")
        return out.select("url", "body", F.when(F.col("body").isNull(), F.col("error")).alias("error"))

    def _fetched(self, urls: DataFrame) -> DataFrame:
        fetcher, pause = self.fetcher, self.pause

        def run(batches):
            last: dict[str, float] = {}
            for pdf in batches:
                out = []
                for url in pdf["url"]:
                    host = urlsplit(url).netloc
                    wait = last.get(host, 0.0) + pause - time.monotonic()
                    if host in last and wait > 0:
                        time.sleep(wait)
                    try:
                        body = fetcher(url)
                        out.append((url, body.encode() if isinstance(body, str) else bytes(body), None))
                    except Exception as e:  # a reply that fails is a row with its error
                        out.append((url, None, f"{type(e).__name__}: {e}"))
                    last[host] = time.monotonic()
                yield pd.DataFrame(out, columns=["url", "body", "error"])

        # a number of tasks of its own: hosts that shared one would wait for each other
        host = F.regexp_extract("url", r"\A[^:]*://([^/?#]*)", 1)
        return urls.repartition(64, host).sortWithinPartitions("url").mapInPandas(run, "url string, body binary, error string")


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes ``body`` as the file ``name`` under ``folder`` for each row, and returns how many. Tasks write, to whatever
    store the folder's address names, each file whole before it takes its name; a task that runs again
    writes the same files again."""
    target = folder if "://" in folder else f"file://{folder}"

    def run(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            for name, body in zip(pdf["name"], pdf["body"], strict=True):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(body)
                store.move(draft, f"{root}/{name}")
            yield pdf[["name"]]

    return rows.select("name", "body").filter(F.col("name").isNotNull() & F.col("body").isNotNull()).mapInPandas(run, "name string").count()
