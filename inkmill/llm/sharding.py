"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a 3-part key: hash of the text, hash of the id, and the row's number in
the key table (unique, so that any two rows can be told apart). Splitters that cut this order into
shards of near-equal bytes are found by counting the exact bytes below candidate boundaries:
each round splits the interval around every open target at 4096 candidates, sums bytes between
them over all partitions (map-side combined; at most 4096 sums for each open interval reach the
driver) and keeps the interval that holds the target, until a boundary lies within the tolerance.
Then the rows are exchanged once, by fine bucket.

A boundary can be no nearer to its target than half the row it falls in. Only documents of more than
``CARRIED`` of a shard's bytes would spoil that; there are at most shards / CARRIED of them (256 for 16
shards), whatever the table. They are carried to the shard with the fewest bytes, largest first, and
stand before its other rows; targets are what each shard lacks then. All other rows are ranges of one
sorted key, and a shard's bytes differ from the mean by at most half a row at either end.

Copies of one text are neighbours in the order, but for carried ones. Only a splitter that falls inside
such a group divides it, which is what lets a group of a third of all rows be cut into near-equal shards.
"""

from __future__ import annotations

import heapq
import logging
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch

_LOG = logging.getLogger(__name__)
#: A document of more than this part of a shard's bytes is carried to a shard instead of cut around.
CARRIED = 1 / 16
_BITS = 12
MOST_SHARDS = 1 << _BITS
#: Key parts from the most significant, as (column, bits).
_PARTS = (("k1", 64), ("k2", 64), ("k3", 64))
_WIDTH = sum(b for _, b in _PARTS)


def _part_value(key: int, part: int) -> int:
    """The signed value of one part of a whole (unsigned) key."""
    below = sum(b for _, b in _PARTS[part + 1 :])
    return ((key >> below) & ((1 << 64) - 1)) - (1 << 63)


def _digit(level: int) -> Column:
    """The 12 bits of the key that round ``level`` splits by."""
    at = level * _BITS
    out, need = None, _BITS
    for name, bits in _PARTS:
        if at >= bits:
            at -= bits
            continue
        take = min(need, bits - at)
        col = F.col(name).bitwiseXOR(F.lit(-(1 << 63)))  # from signed to unsigned order
        piece = F.shiftrightunsigned(col, bits - at - take).bitwiseAND(F.lit((1 << take) - 1))
        out = piece if out is None else F.shiftleft(out, take).bitwiseOR(piece)
        need, at = need - take, 0
        if not need:
            break
    return out


def _prefix(level: int) -> list[Column]:
    """The key's bits above round ``level``, as one column for each part."""
    out, left = [], level * _BITS
    for name, bits in _PARTS:
        take = min(left, bits)
        out.append(F.shiftright(F.col(name), bits - take) if take else F.lit(0).cast("long"))
        left -= take
    return out


def _prefix_values(low: int, level: int) -> list[int]:
    out, left = [], level * _BITS
    for part, (_, bits) in enumerate(_PARTS):
        take = min(left, bits)
        out.append(_part_value(low, part) >> (bits - take) if take else 0)
        left -= take
    return out


def _splitters(keys: DataFrame, wanted: list[tuple[float, float]]) -> list[int]:
    """A key for each (target bytes, tolerance): the bytes below it are within the tolerance
    of the target, or as near as a single row allows."""
    found: list[int | None] = [None] * len(wanted)
    # open interval of each target: level, low key, bytes below the low key
    open_: dict[int, tuple[int, int]] = {i: (0, 0) for i in range(len(wanted))}
    level = 0
    while open_:
        shift = _WIDTH - (level + 1) * _BITS
        last = shift == 0
        spans = {low: j for j, low in enumerate(sorted({low for low, _ in open_.values()}))}
        # open intervals, one row each: a table no longer than the list of targets
        at = keys.sparkSession.createDataFrame(
            [(j, *_prefix_values(low, level)) for low, j in spans.items()], "span int, p1 long, p2 long, p3 long"
        )
        p1, p2, p3 = _prefix(level)
        rows = keys.select("size", _digit(level).alias("digit"), p1.alias("p1"), p2.alias("p2"), p3.alias("p3"))
        rows = rows.join(F.broadcast(at), ["p1", "p2", "p3"]) if level else rows.withColumn("span", F.lit(0))
        counts = rows.groupBy("span", "digit").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        by_span: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["span"], r["digit"])):
            by_span.setdefault(r["span"], []).append(r)
        nxt: dict[int, tuple[int, int]] = {}
        for i, (low, below) in open_.items():
            target, tol = wanted[i]
            for r in by_span[spans[low]]:
                if below + r["b"] >= target:
                    break
                below += r["b"]
            else:
                below -= r["b"]
            start, near, far = low + (r["digit"] << shift), target - below, below + r["b"] - target
            if min(near, far) <= tol or r["n"] == 1 or last:
                found[i] = start if near <= far else start + (1 << shift)
            else:
                nxt[i] = (start, below)
        open_, level = nxt, level + 1
    return [min(k, (1 << _WIDTH) - 1) for k in found]


def _bucket(keys: DataFrame, splitters: list[int], spark: SparkSession) -> DataFrame:
    """Adds the number of splitters at or below each key.

    The splitters are dealt over the 4096 values of the first digit, a table of fixed size that is
    broadcast; the few inside a row's digit are compared in full.
    """
    top = _WIDTH - _BITS
    rows = []
    for digit in range(1 << _BITS):
        lo, hi = digit << top, (digit + 1) << top
        inside = [s for s in splitters if lo < s < hi]
        rows.append((digit, bisect_right(splitters, lo), [tuple(_part_value(s, p) for p in range(3)) for s in inside]))
    schema = T.StructType(
        [
            T.StructField("d", T.LongType()),
            T.StructField("base", T.IntegerType()),
            T.StructField(
                "inside",
                T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n, _ in _PARTS])),
            ),
        ]
    )
    lookup = F.broadcast(spark.createDataFrame(rows, schema))
    key = F.struct("k1", "k2", "k3")
    return (
        keys.withColumn("d", _digit(0))
        .join(lookup, "d")
        .withColumn("bucket", F.col("base") + F.size(F.filter("inside", lambda s: s <= key)))
        .drop("d", "base", "inside")
    )


def _level(loads: list[int], total: int) -> list[float]:
    """Bytes for each shard: equal, but for shards that hold more already."""
    full, even = set(), 0.0
    while True:
        rest = [i for i in range(len(loads)) if i not in full]
        even = (total - sum(loads[i] for i in full)) / len(rest)
        over = {i for i in rest if loads[i] > even}
        if not over:
            return [loads[i] if i in full else even for i in range(len(loads))]
        full |= over


def _carried(keys: DataFrame, shards: int, limit: float) -> tuple[list[tuple[int, int]], list[int]]:
    """(row number, shard) of each row larger than ``limit``, and the bytes of such rows in each shard."""
    large = keys.filter(F.col("size") > limit).select("k3", "size").collect()
    _LOG.info("%d documents of more than %d bytes are carried to their shards", len(large), limit)
    queue = [(0, s) for s in range(shards)]
    loads, places = [0] * shards, []
    for r in sorted(large, key=lambda r: (-r["size"], r["k3"])):
        load, s = heapq.heappop(queue)
        loads[s] = load + r["size"]
        places.append((r["k3"], s))
        heapq.heappush(queue, (loads[s], s))
    return places, loads


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, buckets_per_shard: int = 16, tolerance: float = 0.0005, carried: float = CARRIED
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near-equal bytes, slots gapless from 0.

    ``size`` is the text's UTF-8 bytes plus 1. A boundary is off its target by ``tolerance`` of a
    shard's mean or by half the row that stands there, whichever is more. ``buckets_per_shard`` sets how
    many tasks number the rows of one shard.

    Defined cases: a null text has size 1 and checksum 0; a null id is an ordinary key value;
    a text of more than ``carried`` of the mean is a row of its own place (its copies may lie in
    several shards), and a shard that it fills alone may hold more than the mean; repeated rows are
    separate rows with separate slots; an empty table gives an empty result; extra columns are ignored.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"1 to {MOST_SHARDS} shards")
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = scratch.keep(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64("text").alias("k1"),
            F.xxhash64("doc_id").alias("k2"),
            F.monotonically_increasing_id().alias("k3"),
        ),
        "keys",
    )
    total = hashed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    if not total:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, shard int, slot long")
    limit = carried * total / shards
    places, loads = _carried(hashed, shards, limit)
    lacks = [w - load for w, load in zip(_level(loads, total), loads, strict=True)]
    keys = hashed.filter(F.col("size") <= limit)
    wanted, below = [], 0.0
    for shard, share in enumerate(lacks):
        wanted += [(below + share * i / buckets_per_shard, share / buckets_per_shard / 4) for i in range(1, buckets_per_shard)]
        below += share
        if shard < shards - 1:
            wanted.append((below, tolerance * total / shards))
    cuts = _splitters(keys, wanted) if total > sum(loads) else [0] * len(wanted)
    edges, splitters = sorted(cuts[buckets_per_shard - 1 :: buckets_per_shard]), sorted(set(cuts))
    placed = _bucket(keys, splitters, spark)
    # the carried rows of a shard are a bucket of their own, numbered below 0
    known = F.broadcast(spark.createDataFrame(places, "k3 long, carried int"))
    apart = hashed.filter(F.col("size") > limit).join(known, "k3").withColumn("bucket", -1 - F.col("carried"))
    placed = placed.unionByName(apart.select(placed.columns))
    counts = {r["bucket"]: r["n"] for r in placed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    filled = [counts.get(-1 - s, 0) for s in range(shards)]
    offsets = [(-1 - s, s, 0) for s in range(shards)]
    for i in range(len(splitters) + 1):
        shard = bisect_right(edges, splitters[i - 1]) if i else bisect_right(edges, 0)
        offsets.append((i, shard, filled[shard]))
        filled[shard] += counts.get(i, 0)
    where = F.broadcast(spark.createDataFrame(offsets, "bucket int, shard int, offset long"))
    order = Window.partitionBy("bucket").orderBy("k1", "k2", "k3")
    return (
        placed.withColumn("n", F.row_number().over(order))
        .join(where, "bucket")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("n") - 1 + F.col("offset")).alias("slot"))
    )
