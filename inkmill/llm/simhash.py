"""Near-duplicates by SimHash fingerprints and pigeonhole blocks.

Each text becomes one fingerprint; documents with equal fingerprints are one row from then on.
Tables of keys are built from blocks of fingerprint bits so that close pairs share a key in some
table: for at most d differing bits, the bits are split into d + k blocks and each choice of k
blocks is a table, of which one is untouched (exact). ``keep_one`` goes by a similarity of word runs: links of
fingerprints come first, an exact check of the sets follows, and ``near_copies`` covers what is left apart.

Pairs within a key's group are not enumerated. First every member is compared with one leader of
the group (its most copied fingerprint) and verified links are joined into components. Then only
members outside the group's largest component are compared with the rest, and only across
components, so that a large group of copies costs as many comparisons as it has members. This
loses no component: pairs left out are within one component already.

Everything between the steps is a table in the shared folder; nothing but edge counts reaches the
driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_copies
from .common import Scratch, connected_components, release

SEED = 42


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; of the whole if there are fewer."""
    import xxhash

    if len(words) < width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, len(shingles))


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit hashes for each hash, by splitmix64; one word is the hash itself."""
    if words == 1:
        return h[:, None]
    with np.errstate(over="ignore"):
        z = h[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of an (n, words) array, lowest bit first.

    Three rows of one weight are added into a sum and a carry (a full adder over all bits at
    once) until two or fewer are left of each weight.
    """
    total = np.zeros(rows.shape[1] * 64, np.int64)
    weight = 0
    while len(rows):
        carries = []
        while len(rows) > 64:
            m = len(rows) // 3
            a, b, c, rest = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m], rows[3 * m :]
            u = a ^ b
            carries.append((a & b) | (u & c))
            rows = np.concatenate((u ^ c, rest))
        bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64) << weight
        rows, weight = (np.concatenate(carries) if carries else rows[:0]), weight + 1
    return total


def fingerprint_bits(h: np.ndarray, words: int = 1) -> np.ndarray:
    """Bits set in over half of the hashes, lowest first; all zero for no hashes."""
    if not len(h):
        return np.zeros(64 * words, np.uint8)
    total = sum(bit_counts(_mixed(h[i : i + (1 << 16)], words)) for i in range(0, len(h), 1 << 16))
    return (2 * total > len(h)).astype(np.uint8)


def pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little").view(np.int64)


def block_tables(bits: int = 64, distance: int = 3, kept: int = 2) -> list[np.ndarray]:
    """Bit positions of each table's key, so that fingerprints within ``distance`` share a key:
    all choices of ``kept`` out of ``distance + kept`` blocks."""
    blocks = np.array_split(np.arange(bits), distance + kept)
    return [np.concatenate(c) for c in itertools.combinations(blocks, kept)]


def fingerprints(
    docs: DataFrame, id_col: str, describe: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], tables: list[np.ndarray], text: str = "text"
) -> DataFrame:
    """(id, fp array<long>, keys array<long>) of every document.

    ``describe`` gets the words of a text (A-Z lower-cased, split at ASCII white space) and returns
    the bits of the fingerprint and the bits that keys are taken from.
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("fp", longs).add("keys", longs)

    def run(batches):
        weights = [1 << np.arange(len(t), dtype=np.int64) for t in tables]
        for batch in batches:
            fps, keys = [], []
            for t in batch.column(text).to_pylist():
                bits, key_bits = describe((t or "").encode().lower().split())
                fps.append(pack(bits))
                keys.append(np.array([key_bits[t] @ w for t, w in zip(tables, weights, strict=True)], np.int64))
            n = batch.num_rows
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(x) for x in xs]))).astype(np.int32)), pa.array(np.concatenate(xs) if n else np.array([], np.int64))
                )
                for xs in (fps, keys)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *lists], names=["id", "fp", "keys"])
            release()

    return docs.select(id_col, text).mapInArrow(run, schema)


def _distance(a: Column, b: Column, words: int) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)), F.lit(0))


def near_groups(prints: DataFrame, words: int, distance: int) -> DataFrame:
    """(id, fp, component_id) from ``fingerprints``: the smallest id reachable over links of
    fingerprints that share a key and differ in at most ``distance`` bits, itself included.

    Null ids belong to their groups; a group's id is null only if it has no other. Repeated ids
    are repeated rows. Empty in, empty out.
    """
    scratch = Scratch(prints.sparkSession, "simhash")
    docs = scratch.keep(prints, "docs")
    # one row for each distinct fingerprint, numbered once and for all by being written
    distinct = scratch.keep(
        docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.any_value("keys").alias("keys")).select(
            "*", F.monotonically_increasing_id().alias("u")
        ),
        "distinct",
    )
    rows = distinct.select("u", "n", F.posexplode("keys").alias("t", "key"))
    groups = scratch.keep(
        rows.groupBy("t", "key")
        .agg(F.count("*").alias("c"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.max_by("u", "n").alias("leader"))
        .filter("c > 1"),
        "groups",
    )
    prints_of = distinct.select("u", "fp")
    large = scratch.keep(rows.drop("n").join(groups.filter("c > 2").select("t", "key", "leader"), ["t", "key"]).join(prints_of, "u"), "large")
    stars = (
        groups.filter("c = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        .unionByName(large.filter("u <> leader").select(F.least("u", "leader").alias("a"), F.greatest("u", "leader").alias("b")))
        .distinct()
    )
    linked = (
        stars.join(prints_of.select(F.col("u").alias("a"), F.col("fp").alias("fa")), "a")
        .join(prints_of.select(F.col("u").alias("b"), F.col("fp").alias("fb")), "b")
        .filter(_distance(F.col("fa"), F.col("fb"), words) <= distance)
        .select("a", "b")
    )
    first = scratch.keep(connected_components(scratch, linked), "first")

    # the rest of the large groups: members outside the largest component, across components
    labelled = scratch.keep(
        large.join(first.withColumnRenamed("node", "u"), "u", "left").select("t", "key", "u", "fp", F.coalesce("component", "u").alias("label")), "labelled"
    )
    main = (
        labelled.groupBy("t", "key", "label").agg(F.count("*").alias("c"))
        .groupBy("t", "key").agg(F.max_by("label", "c").alias("main"), F.count("*").alias("labels"))
        .filter("labels > 1").select("t", "key", "main")
    )
    mixed = labelled.join(main, ["t", "key"])
    others = mixed.filter("label <> main").select("t", "key", F.col("label").alias("la"), F.col("fp").alias("fa"))
    against = mixed.select("t", "key", F.col("label").alias("lb"), F.col("fp").alias("fb"), "main")
    crossing = others.join(
        against,
        (others.t == against.t) & (others.key == against.key) & (F.col("la") != F.col("lb"))
        & ((F.col("la") < F.col("lb")) | (F.col("lb") == F.col("main")))
        & (_distance(F.col("fa"), F.col("fb"), words) <= distance),
    )
    merged = connected_components(scratch, crossing.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    final = first.join(merged.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select(
        F.col("node").alias("u"), F.coalesce("root", "component").alias("root")
    )
    # a fingerprint that joins only by the second pass is its own label and so a node of ``merged``
    alone = merged.join(first.select("node"), "node", "left_anti").select(F.col("node").alias("u"), F.col("component").alias("root"))
    label = scratch.keep(final.unionByName(alone), "label")

    named = distinct.select("u", "fp", "least", "n").join(label, "u", "left").withColumn("root", F.coalesce("root", "u"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("parts"), F.max("n").alias("copies"))
    shared = named.select("root", "fp").join(least.filter("parts > 1 OR copies > 1"), "root").select("fp", "component_id")
    out = docs.select("id", "fp").join(shared, "fp", "left").select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))
    scratch.drop(groups, large, first, labelled)
    return out


def contract_groups(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): 64-bit fingerprints of ``shingle``-word runs, linked at
    ``distance`` or fewer differing bits.

    Defined cases: null and empty texts, and those of white space, have fingerprint zero and are
    linked like any others; shorter texts have their whole word sequence as the one shingle; for
    ids see ``near_groups``; extra columns are ignored.
    """

    def describe(words):
        bits = fingerprint_bits(shingle_hashes(words, shingle))
        return bits, bits

    prints = fingerprints(docs, "doc_id", describe, block_tables(64, distance, 2))
    groups = near_groups(prints, 1, distance)
    return groups.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex(F.get("fp", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id"
    )


#: Up to so many dropped rows are broadcast (as 8-byte numbers, under 64 MB); beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000


def _row_ids(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with ``_row``, a number of each row that is the same in every scan: its file's hash
    and its place in the file. A frame that is not a plain scan of files is written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = scratch.keep(docs, "docs")
    return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias("_row"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest doc_id stays
    (null ids last), of repeated ids one row. Columns are those of ``docs``.

    Defined cases: texts without a word are copies of each other; an empty table gives an empty
    result; other columns are carried along, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if "_row" in docs.columns or "_metadata" in docs.columns:
        names = {c: f"_other{i}" for i, c in enumerate(others)}
        docs = scratch.keep(docs.withColumnsRenamed(names), "docs")
        out = keep_one(docs, **how)
        return out.withColumnsRenamed({v: k for k, v in names.items()})
    numbered = _row_ids(docs, scratch)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    rows, kept = near_copies.survivors(scratch, numbered.select("_row", "doc_id", "text"), "_row", ["doc_id"], rank, **how)
    dropped = scratch.keep(rows.join(kept, "_row", "left_anti"), "dropped")
    scratch.drop_but(dropped)
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return numbered.join(dropped, "_row", "left_anti").drop("_row")
