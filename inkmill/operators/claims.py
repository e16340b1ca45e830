"""Claims by event: the primary side, the authors, and the pairs to compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import doc_info


def in_order(order: str, value: str) -> Column:
    """All elements of the arrays in ``value``, in order of ``order``."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]))


def _with_claims(rows: DataFrame, dimension: DataFrame | None) -> DataFrame:
    rows = rows.filter(F.size("claims") > 0)
    return rows.join(F.broadcast(dimension.select("event")), "event", "left_semi") if dimension is not None else rows


def primary_claims(extractions: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """(event, claims): claims of all primary documents, in document order (``doc_ord``)."""
    return _with_claims(extractions, dimension).groupBy("event").agg(in_order("doc_ord", "claims").alias("claims"))


def author_claims(extractions: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """(event, author, claims, doc_title, doc_id): an author's claims, and the first document they are in."""
    named = _with_claims(extractions, dimension).withColumn("author", F.coalesce("author", F.lit("Unknown")))
    return named.groupBy("event", "author").agg(
        in_order("doc_ord", "claims").alias("claims"), F.min_by("document_title", "doc_ord").alias("doc_title"), F.min_by("document_id", "doc_ord").alias("doc_id")
    )


def comparison_pairs(primary: DataFrame, authors: DataFrame) -> DataFrame:
    """One row for each event that has primary claims and each author with claims on it."""
    return primary.select("event", F.col("claims").alias("primary_claims")).join(
        authors.select("event", "author", F.col("claims").alias("author_claims"), doc_info(F.col("doc_title"), F.col("doc_id")).alias("doc_info")), "event"
    )


def event_counts(primary: DataFrame, authors: DataFrame) -> DataFrame:
    """(event, primary_claims, authors, author_claims) counts."""
    a = authors.groupBy("event").agg(F.count("*").alias("authors"), F.sum(F.size("claims")).alias("author_claims"))
    p = primary.select("event", F.size("claims").alias("primary_claims"))
    return p.join(a, "event", "full_outer").na.fill(0)


def events_in_pairs(pairs: DataFrame) -> DataFrame:
    """(events, pairs): how many distinct events the comparison pairs have, and how many pairs there are."""
    return pairs.agg(F.count_distinct("event").alias("events"), F.count("*").alias("pairs"))


def document_counts(extractions: DataFrame) -> DataFrame:
    """(document_id, events_with_claims, claims)."""
    return extractions.groupBy("document_id").agg(F.count_if(F.size("claims") > 0).alias("events_with_claims"), F.sum(F.greatest(F.size("claims"), F.lit(0))).alias("claims"))


def flatten_run(run: DataFrame, side: str) -> DataFrame:
    """Extraction rows of one side (``loc`` or ``gutenberg``) of a run envelope, in document order.

    Documents without extractions give none.
    """
    docs = run.select(F.posexplode(f"{side}_extractions").alias("doc_ord", "d"))
    return docs.select("doc_ord", "d.document_id", "d.document_title", "d.document_type", F.explode("d.extractions").alias("e")).select(
        "doc_ord", "document_id", "document_title", "document_type", "e.*"
    )
