"""``python -m inkmill.plans``: fetch raw files, clean them, combine data sets, report on them, extract events.

Models are named as ``module:factory``, a function without arguments that returns the provider.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from ..operators import documents
from ..sources import files
from . import jobs


def _provider(name: str | None):
    if not name:
        return None
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="inkmill.plans", description=__doc__)
    p.add_argument("stage", choices=["fetch", "clean", "combine", "report", "all", "extract"])
    p.add_argument("--raw", default="data/raw")
    p.add_argument("--processed", default="data/processed")
    p.add_argument("--out", default="data/extractions")
    p.add_argument("--model", default="inkmill.models:KeywordCompleter", help="provider of replies")
    p.add_argument("--embedder", help="provider of vectors: books are then searched instead of read by batches")
    p.add_argument("--ids", type=int, nargs="*", default=[], help="books to fetch")
    p.add_argument("--urls", nargs="*", default=[], help="archive items to fetch")
    p.add_argument("--fetcher", help="provider of replies to URLs, in place of HTTP")
    only = p.add_mutually_exclusive_group()
    only.add_argument("--books", action="store_true", help="books only")
    only.add_argument("--archive", action="store_true", help="archive documents only")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("inkmill").getOrCreate()
    if a.stage == "fetch":
        fetcher = _provider(a.fetcher)
        if a.ids and not a.archive:
            jobs.fetch_books(spark, a.ids, a.raw, fetcher).show(truncate=False)
        if a.urls and not a.books:
            jobs.fetch_archive(spark, a.urls, a.raw, fetcher).select("id", "document_type", "files").show(truncate=False)
    if a.stage in ("clean", "all"):
        jobs.build_dataset(spark, a.raw, a.processed, books=not a.archive, archive=not a.books)
    if a.stage in ("combine", "all"):
        files.write_rows(jobs.combine_dataset(spark, a.processed), f"{a.processed}/all")
    if a.stage == "extract":
        jobs.run_extraction(spark, a.processed, a.out, _provider(a.model), _provider(a.embedder), books_only=a.books)
    if a.stage in ("report", "all"):
        documents.report(jobs.combine_dataset(spark, a.processed), "source").show(truncate=False)


if __name__ == "__main__":
    main()
