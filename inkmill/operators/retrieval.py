"""Keyword search (BM25), exact vector search and their fusion by reciprocal ranks.

Searches are batches: a frame of queries against all units, whose key is one or more columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import tokenize
from ..functions.vectors import dot, normalize

# BM25 parameters, the fusion constant and weights, and how many hits are kept.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT = 60, 0.5, 0.5
VECTOR_TOP, KEYWORD_TOP, FUSED_TOP, OVERFETCH = 15, 15, 5, 3

#: Up to so many query terms (rows of about 100 bytes) are broadcast.
BROADCAST_TERMS = 500_000
#: Scores that agree to this many places are ties, which go to smaller keys.
PLACES = 9


@dataclass
class KeywordIndex:
    """``postings``: key, term, tf, dl. ``terms``: term, idf, floored where a term is in over half the units."""

    postings: DataFrame
    terms: DataFrame
    average_length: DataFrame
    key: tuple[str, ...]


def keyword_index(units: DataFrame, key: tuple[str, ...], text: str = "text") -> KeywordIndex:
    """Term frequencies, document frequencies and the average length over all units."""
    # dealt out by key once: counting terms and adding up scores by (query, key) then need no other
    # exchange. The number is explicit because scores outgrow the small tables that Spark would merge.
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = units.select(*key, tokenize(F.coalesce(F.col(text), F.lit(""))).alias("terms")).repartition(parts, *key)
    postings = tokens.select(*key, F.size("terms").alias("dl"), F.explode_outer("terms").alias("term")).filter("term IS NOT NULL").groupBy(*key, "dl", "term").agg(F.count("*").alias("tf"))
    # (explode_outer, since Spark would filter the scan by the size of an exploded array, at the cost of
    # splitting every text twice)
    # all statistics come from the postings, which the search reads too, so texts are split once:
    # counting ``tf`` keeps the shuffled postings the same in every branch, and Spark reuses them
    n = units.agg(F.count("*").alias("n"))
    length = postings.agg(F.sum("tf").alias("total")).crossJoin(n).select("n", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("avgdl"))
    raw = (
        postings.groupBy("term").agg(F.count("tf").alias("df")).crossJoin(F.broadcast(n))
        .select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    )
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return KeywordIndex(postings, terms, length.select("avgdl"), key)


def keyword_search(index: KeywordIndex, queries: DataFrame, k: int = KEYWORD_TOP, only: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, key, rank, score): up to ``k`` units with a score above zero for each query.

    ``queries``: query_id, query. A term that a query repeats counts as often. ``only`` is a
    (query column, key column) pair that must be equal, as in a search within one document;
    statistics stay those of all units.
    """
    extra = [only[0]] if only else []
    asked = queries.select("query_id", *[F.col(c).alias("_only") for c in extra], F.explode(tokenize(F.col("query"))).alias("term"))
    # few query terms go to the postings, which then stay where they are; many are joined by a shuffle
    few = asked.count() <= BROADCAST_TERMS
    asked = asked.groupBy("query_id", *["_only"] * bool(only), "term").agg(F.count("*").alias("qf")).join(index.terms, "term")
    asked = F.broadcast(asked) if few else asked
    hits = index.postings.join(asked, "term").crossJoin(F.broadcast(index.average_length))
    if only:
        hits = hits.filter(F.col(only[1]) == F.col("_only"))
    weight = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", *index.key).agg(F.sum(weight).alias("score")).filter("score > 0")
    return _top(scored, index.key, k)


def _top(scored: DataFrame, key: tuple[str, ...], k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", PLACES).desc(), *key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", *key, "rank", "score")


#: Vectors and queries that meet in one product.
BLOCK = 2048


def vector_search(vectors: DataFrame, queries: DataFrame, key: tuple[str, ...], k: int = VECTOR_TOP, only: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, key, rank, score): the ``k`` vectors nearest by cosine, exactly.

    ``vectors``: key, embedding; ``queries``: query_id, embedding. With ``only``, the nearest
    ``OVERFETCH`` times ``k`` are found among all vectors first and then filtered, so a query may keep
    fewer than ``k``. Null vectors take no part. Vectors and queries are hashed into blocks of
    about 2048; each pair of blocks is one product that keeps its best hits, and ranks follow
    from those.
    """
    wide = k * OVERFETCH if only else k
    vectors = vectors.filter(F.col("embedding").isNotNull())
    queries = queries.filter(F.col("embedding").isNotNull())
    n, m = (max(1, -(-df.count() // BLOCK)) for df in (vectors, queries))
    units = vectors.select(*key, normalize(F.col("embedding")).alias("v"), F.pmod(F.xxhash64(*key), F.lit(n)).alias("c"))
    units = units.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    asked = queries.select("query_id", normalize(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("d"))
    asked = asked.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    names = ["query_id", *key, "score"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in names})
        left = left.sort_values(list(key), ignore_index=True)
        scores = np.array(right["v"].tolist()) @ np.array(left["v"].tolist()).T
        rounded = np.round(scores, PLACES)
        # rows are in order of their keys, so a stable sort settles ties
        best = np.argsort(-rounded, axis=1, kind="stable")[:, :wide]
        out = left[list(key)].iloc[best.ravel()].reset_index(drop=True)
        out.insert(0, "query_id", np.repeat(right["query_id"].to_numpy(), best.shape[1]))
        return out.assign(score=np.take_along_axis(scores, best, 1).ravel())

    fields = [queries.schema["query_id"], *(vectors.schema[c] for c in key)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    hits = units.groupBy("c", "d").cogroup(asked.groupBy("c", "d")).applyInPandas(meet, ddl)
    top = _top(hits, key, wide)
    if not only:
        return top
    near = top.join(queries.select("query_id", F.col(only[0]).alias("_only")), "query_id").filter(F.col(only[1]) == F.col("_only"))
    order = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", *key, "rank", "score")


def vector_search_within(vectors: DataFrame, queries: DataFrame, key: tuple[str, ...], only: tuple[str, str], k: int = VECTOR_TOP) -> DataFrame:
    """As ``vector_search``, among the vectors alone whose ``only[1]`` is the query's ``only[0]``: a join
    on it, so work grows with the pairs that may be hits and each query keeps ``k`` of them."""
    units = vectors.filter(F.col("embedding").isNotNull()).select(*key, F.col(only[1]).alias("_of"), normalize(F.col("embedding")).alias("v"))
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", F.col(only[0]).alias("_of"), normalize(F.col("embedding")).alias("q"))
    return _top(units.join(asked, "_of").select("query_id", *key, dot(F.col("v"), F.col("q")).alias("score")), key, k)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, key: tuple[str, ...], k: int = FUSED_TOP) -> DataFrame:
    """(query_id, key, rank, score): hits of either list by the sum of their reciprocal ranks.

    Ties go to the better vector rank, then to the better keyword rank, then to smaller keys.
    """
    side = lambda df, name, w: df.select("query_id", *key, F.col("rank").alias(name), (w / (RRF_K + F.col("rank"))).alias(f"{name}_part"))
    both = side(vector_hits, "vector", VECTOR_WEIGHT).join(side(keyword_hits, "keyword", KEYWORD_WEIGHT), ["query_id", *key], "full_outer")
    part = lambda name: F.coalesce(F.col(f"{name}_part"), F.lit(0.0))
    scored = both.withColumn("score", part("vector") + part("keyword"))
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", 12).desc(), F.col("vector").asc_nulls_last(), F.col("keyword").asc_nulls_last(), *key
    )
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", *key, "rank", "score")


def hybrid_search(
    index: KeywordIndex, vectors: DataFrame, queries: DataFrame, k: int = FUSED_TOP, only: tuple[str, str] | None = None, filter_first: bool = False
) -> DataFrame:
    """Keyword and vector search of the same queries (query_id, query, embedding), fused. With ``only``,
    vectors are over-fetched among all and then filtered, or filtered first."""
    near = vector_search_within(vectors, queries, index.key, only) if only and filter_first else vector_search(vectors, queries, index.key, VECTOR_TOP, only)
    return fuse(near, keyword_search(index, queries, KEYWORD_TOP, only), index.key, k)
