"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is one or more 64-bit words, each cut into segments of about log2(N) bits, at most
``MOST_WIDTH``. All distinct codes are indexed by each segment. In round r every open query probes,
in each of the m segments, the values that differ from its own in exactly r bits; a code is taken
in the round and segment where it is first met, which its own bits tell, so nothing is found twice.
After round r all codes within m(r + 1) - 1 bits have been met. A query is closed when k + 1
verified ids lie within that distance, or all codes have been met; the others go on to the next
radius. Codes further than the k-th neighbour so far are passed over in the join, so that what a
round returns does not grow with the codes it meets.

Codes and query codes are worked on once each, however many rows have them. Of one code only the
k + 1 smallest ids can be among anyone's k nearest (equal distances go to smaller ids). Probes are
made in as many tasks as their number asks for.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch

BITS = 64
#: Most bits of a segment: no radius has more than 184,756 values to probe in one.
MOST_WIDTH = 20
#: Probes that one task makes.
PROBES_PER_TASK = 1_000_000


def sign_code(vector: Column) -> Column:
    """Array of 64-bit words with a bit for each component: set where it is above zero. Null for null
    and empty vectors and those with null or NaN components."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(none)
    word = lambda w: F.aggregate(F.transform(F.slice(vector, w * BITS + 1, BITS), bit), none, lambda a, b: a.bitwiseOR(b))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / BITS).cast("int")), word))


def _least_ids(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, id) of the ``k`` smallest ids of each key; a frequent key is ranked in parts first."""
    part = F.pmod(F.xxhash64("id"), F.lit(32))
    by = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy("id"))
    some = rows.withColumn("p", part).withColumn("r", by(key, "p")).filter(F.col("r") <= k).drop("r", "p")
    return some.withColumn("r", by(key)).filter(F.col("r") <= k).drop("r")


def _segments(words: int, codes: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of each segment, about log2(codes) bits wide."""
    width = min(float(MOST_WIDTH), max(4.0, math.log2(max(2, codes))))
    a_word = max(2, min(8, math.ceil(BITS / width - 0.5)), math.ceil(BITS / MOST_WIDTH))
    cuts = [BITS * i // a_word for i in range(a_word + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _segment(code: Column, word: int, first: int, width: int) -> Column:
    return F.shiftrightunsigned(F.get(code, F.lit(word)), first).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set, as one literal."""
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)], np.int64)


def _flipped(word: int, first: int, width: int, mask: Column) -> Column:
    return _segment(F.col("qcode"), word, first, width).bitwiseXOR(mask)


def _distance(words: int) -> Column:
    return sum((F.bit_count(F.get("code", F.lit(w)).bitwiseXOR(F.get("qcode", F.lit(w)))) for w in range(words)), F.lit(0))


def search(codes: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance) of the ``k`` nearest other rows of each query row.

    ``codes``: id, code (a 64-bit long, or an array of them; words that a code lacks are zero). Rows
    with a null id or code, or a null word, take no part. Equal distances go to the smaller id; of
    repeated (id, code) rows one counts, of one id with several codes the nearest; rows with the
    query's own id are not its neighbours. Fewer than ``k`` others: all are returned. Extra columns
    are ignored. Empty in, empty out.
    """
    scratch = Scratch(codes.sparkSession, "mih")
    code = F.col("code") if isinstance(codes.schema["code"].dataType, T.ArrayType) else F.when(F.col("code").isNotNull(), F.array("code"))
    valid = codes.select("id", code.alias("code"), is_query.alias("q")).filter("id IS NOT NULL AND code IS NOT NULL AND NOT exists(code, x -> x IS NULL)")
    words = max(1, valid.agg(F.max(F.size("code"))).first()[0] or 1)
    padded = F.slice(F.concat("code", F.array_repeat(F.lit(0).cast("long"), words)), 1, words)
    rows = scratch.keep(valid.withColumn("code", padded).distinct(), "rows")
    least = scratch.keep(_least_ids(rows.select("id", "code"), "code", k + 1), "least")
    distinct = scratch.keep(rows.groupBy("code").agg(F.count("*").alias("n")), "codes")
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("c")).first()
    segments = _segments(words, total["c"])
    m = len(segments)

    table = F.array(*[F.struct(F.lit(j).alias("seg"), _segment(F.col("code"), *s).alias("val")) for j, s in enumerate(segments)])
    index = scratch.keep(distinct.select("code", "n", F.inline(table)), "index")
    open_ = scratch.keep(rows.filter("q").select(F.col("code").alias("qcode"), F.lit(BITS * words).alias("bar")).distinct(), "open")
    empty = codes.sparkSession.createDataFrame([], "qcode array<long>, id long, distance int")
    best, met = scratch.keep(empty, "best"), None
    parts = []
    for radius in range(max(s[2] for s in segments) + 1):
        waiting = open_.count()
        if not waiting:
            break
        masks = [_masks(s[2], radius) for s in segments]
        probes = F.array(
            *[
                F.struct(F.lit(j).alias("seg"), F.transform(F.lit(masks[j]), functools.partial(_flipped, *s)).alias("vals"))
                for j, s in enumerate(segments)
                if len(masks[j])
            ]
        )
        tasks = -(-waiting * sum(map(len, masks)) // PROBES_PER_TASK)
        dealt = open_.repartition(max(1, min(waiting, tasks)), "qcode")
        probe = dealt.select("qcode", "bar", F.inline(probes)).select("qcode", "bar", "seg", F.explode("vals").alias("val"))
        apart = _distance(words)
        each = [F.bit_count(_segment(F.col("code"), *s).bitwiseXOR(_segment(F.col("qcode"), *s))) for s in segments]
        # first met here: no segment is nearer, and no earlier one is as near
        here = F.lit(False)
        for j in range(m):
            ok = F.col("seg") == j
            for e in [each[i] > radius for i in range(j)] + [each[i] >= radius for i in range(j + 1, m)]:
                ok = ok & e
            here = here | ok
        near = here & (apart <= F.col("bar"))
        # Spark takes the exploded probes for a small table; they are not one to broadcast
        met_now = probe.hint("merge").join(index, ["seg", "val"]).filter(near)
        found = scratch.keep(met_now.select("qcode", "code", "n", apart.alias("distance")), "found")
        covered = m * (radius + 1) - 1
        counts = found.groupBy("qcode", "distance").agg(F.sum("n").alias("n"))
        if met is not None:
            counts = met.unionByName(counts).groupBy("qcode", "distance").agg(F.sum("n").alias("n"))
        met = scratch.keep(counts, "met")
        ranked = (
            found.join(least, "code").select("qcode", "id", "distance").unionByName(best)
            # one id with several codes takes one place, with its nearest
            .groupBy("qcode", "id").agg(F.min("distance").alias("distance"))
            .withColumn("r", F.row_number().over(Window.partitionBy("qcode").orderBy("distance", "id")))
            .filter(F.col("r") <= k + 1).drop("r")
        )
        best = scratch.keep(ranked, "best")
        within = best.filter(F.col("distance") <= covered).groupBy("qcode").agg(F.count("*").alias("within"))
        closed = (
            met.groupBy("qcode").agg(F.sum("n").alias("met")).join(within, "qcode", "left")
            .filter((F.col("within") >= k + 1) | (F.col("met") >= total["n"])).select("qcode")
        )
        parts.append(scratch.keep(best.join(closed.join(open_, "qcode", "left_semi"), "qcode", "left_semi"), "closed"))
        bars = best.groupBy("qcode").agg(F.max("distance").alias("last"), F.count("*").alias("c"))
        still = open_.select("qcode").join(closed, "qcode", "left_anti").join(bars, "qcode", "left")
        open_ = scratch.keep(still.select("qcode", F.when(F.col("c") == k + 1, F.col("last")).otherwise(BITS * words).alias("bar")), "open")
    result = functools.reduce(DataFrame.unionByName, parts, empty)
    queries = rows.filter("q").select(F.col("id").alias("query_id"), F.col("code").alias("qcode"))
    near = queries.join(result, "qcode").filter("id <> query_id")
    # one id with several codes: its nearest code counts
    near = near.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    scratch.drop_but(rows, *parts)
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
