"""Exact nearest vectors without all pairs: Voronoi cells of pivots, met only where their bounds reach the k-th hit.

Every vector, at length one, goes to its nearest pivot. A cell keeps its number of rows and the least and the
greatest distance of its members to the pivot. By the triangle inequality no member of a cell is nearer to a
query than the query's distance to the pivot less the greatest one, or the least one less that distance, nor
than the distance to the border with the query's own cell. A query first meets its nearest cells until they hold ``k`` rows; the k-th
distance there bars all cells whose bound lies beyond it. Any pivots are exact; good ones bar more.

Cells are hashed into blocks of rows, so that a cell with most rows of the table is many tasks, and queries
meet a block in one product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import normalize
from ..shared import new_folder
from .retrieval import BLOCK, PLACES, VECTOR_TOP, _top

#: Pivots at most, the bytes that they and the sample they come from may have on the driver, and rows of a cell aimed at.
PIVOTS, SAMPLE_BYTES, CELL_ROWS = 512, 64 << 20, 64


@dataclass
class CellHits:
    """``hits``: query_id, key, rank, score. ``met``: query_id, cells that it met, cells there are."""

    hits: DataFrame
    met: DataFrame


def choose_pivots(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` unit vectors: rows far from each other, moved to the means of what is nearest to them."""
    centers = sample[:1]
    nearest = sample @ centers[0] if len(sample) else np.zeros(0)
    chosen = [0] if len(sample) else []
    while len(chosen) < min(k, len(sample)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    centers = sample[chosen]
    for _ in range(rounds if len(centers) else 0):
        own = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centers)
    return centers


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (v @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def cell_search(vectors: DataFrame, queries: DataFrame, key: tuple[str, ...], k: int = VECTOR_TOP, cell_rows: int = CELL_ROWS) -> CellHits:
    """The ``k`` vectors (key, embedding) nearest by cosine to each query (query_id, embedding), exactly, as
    ``retrieval.vector_search`` finds them. All vectors have the same number of components; null ones take no part; a zero
    vector has the score 0 with everything."""
    spark = vectors.sparkSession
    folder = new_folder(spark, "cells")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    unit = lambda df, names: df.filter(F.col("embedding").isNotNull()).select(*names, normalize(F.col("embedding")).alias("v"))
    rows = kept(unit(vectors, key), "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    asked = unit(queries, ["query_id"])
    fields = [queries.schema["query_id"], *(vectors.schema[c] for c in key)]
    if not n:
        none = T.StructType([*fields, T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())])
        counts = T.StructType([fields[0], T.StructField("met", T.LongType()), T.StructField("cells", T.IntegerType())])
        return CellHits(spark.createDataFrame([], none), spark.createDataFrame([], counts))
    most = max(1, SAMPLE_BYTES // (8 * width) // 8)
    wanted = max(1, min(PIVOTS, most // 8, n // cell_rows))
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 30))
    share = min(1.0, 16 * wanted / n) if n else 1.0
    sample = rows.filter(h <= int(share * (1 << 30))).orderBy(h, *key).limit(min(most, 16 * wanted)).select("v").toPandas()["v"].tolist()
    pivots = choose_pivots(np.array(sample, float).reshape(len(sample), -1) if sample else np.zeros((1, width)), wanted)
    shared = spark.sparkContext.broadcast(pivots)
    between = _distances(pivots, pivots)

    def place(batches):
        for pdf in batches:
            d = _distances(np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1), shared.value) if len(pdf) else np.zeros((0, len(shared.value)))
            own = d.argmin(1) if len(pdf) else np.zeros(0, int)
            yield pdf.assign(cell=own.astype(np.int32), away=d[np.arange(len(pdf)), own])

    cells = kept(rows.mapInPandas(place, T.StructType([*rows.schema.fields]).add("cell", "integer").add("away", "double")), "placed")
    # one row for each pivot
    sizes = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect()}
    names = np.array(sorted(sizes), int)
    count, low, high = (np.array([sizes[c][f] for c in names], float) for f in ("n", "lo", "hi"))

    def plan(batches):
        """The bound of every cell for a query, the nearest cells first, and which of them come before there are k rows."""
        for pdf in batches:
            for q, v in zip(pdf["query_id"], pdf["v"], strict=True):
                d = _distances(np.array(v, float)[None, :], shared.value)[0]
                own = int(d.argmin())
                border = np.zeros(len(names))
                apart = between[own, names] > 1e-9
                border[apart] = (d[names][apart] ** 2 - d[own] ** 2) / (2 * between[own, names][apart])
                bound = np.maximum.reduce([d[names] - high, low - d[names], border, np.zeros(len(names))])
                order = np.lexsort((d[names], bound))
                before = np.cumsum(count[order]) - count[order]
                yield pd.DataFrame({"query_id": q, "cell": names[order].astype(np.int32), "bound": bound[order], "early": before < k})

    schema = T.StructType([queries.schema["query_id"]]).add("cell", "integer").add("bound", "double").add("early", "boolean")
    bounds = kept(asked.mapInPandas(plan, schema), "bounds")
    blocks = F.create_map(*[F.lit(x) for c, m in zip(names.tolist(), count, strict=True) for x in (c, max(1, -(-int(m) // BLOCK)))])
    stored = cells.select(*key, "v", "cell", F.pmod(F.xxhash64(*key), blocks[F.col("cell")]).alias("block"))
    ddl = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    outputs = [f.name for f in ddl]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in outputs})
        left = left.sort_values(list(key), ignore_index=True)
        scores = np.array(right["v"].tolist()) @ np.array(left["v"].tolist()).T
        best = np.argsort(-np.round(scores, PLACES), axis=1, kind="stable")[:, :k]
        out = left[list(key)].iloc[best.ravel()].reset_index(drop=True)
        out.insert(0, "query_id", np.repeat(right["query_id"].to_numpy(), best.shape[1]))
        return out.assign(score=np.take_along_axis(scores, best, 1).ravel())

    def hits(pairs: DataFrame) -> DataFrame:
        """The best of each block that a query (query_id, cell) meets; queries are dealt in blocks, too."""
        dealt = pairs.join(asked, "query_id").withColumn("block", F.explode(F.sequence(F.lit(0), (blocks[F.col("cell")] - 1).cast("int"))))
        part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-total // BLOCK)))).cast("int")
        dealt = dealt.select("query_id", "v", "cell", F.col("block").cast("long").alias("block"), part.alias("part"))
        groups = dealt.select("cell", "block", "part").distinct().toDF("c", "b", "p")
        there = stored.join(groups, (F.col("cell") == F.col("c")) & (F.col("block") == F.col("b"))).select(*key, F.col("v").alias("v"), F.col("c").alias("cell"), F.col("b").alias("block"), F.col("p").alias("part"))
        on = ["cell", "block", "part"]
        return there.groupBy(*on).cogroup(dealt.groupBy(*on)).applyInPandas(meet, ddl)

    total = asked.count()
    early = kept(_top(hits(bounds.filter("early").select("query_id", "cell")), key, k), "early")
    # unit vectors: the square of a distance is 2 - 2 cosine. What is equal within the noise of products is met
    kth = early.filter(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("kth"))
    late = bounds.filter(~F.col("early")).join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("bound") <= F.col("kth") + 1e-6)).select("query_id", "cell")
    late = kept(late, "late")
    every = early.drop("rank").unionByName(hits(late))
    met = bounds.filter("early").select("query_id", "cell").unionByName(late).groupBy("query_id").agg(F.count("*").alias("met")).withColumn("cells", F.lit(len(names)))
    return CellHits(_top(every, key, k), met)
