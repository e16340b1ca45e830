"""Near copies: texts whose shingle sets have a Jaccard similarity of at least a threshold, exactly.

Each text becomes the set of hashes of its word runs; texts with equal sets are one row from then
on. All sets are put in one common order, rare shingles first. Two sets of similarity s or more
share a shingle among the first n - ceil(s n) + 1 of the larger set and the first
n - ceil(2s / (1 + s) n) + 1 of the smaller one (prefix filter), so these are the keys: no pair is
missed. What is rare is told by a sample of texts; any order is exact, a better one only makes
smaller groups.

A pair that shares a key is passed over where its sizes, or a parity bitmap of each set, show that
it is below the threshold: two sets differ in at least as many shingles as their bitmaps in bits.
A bitmap has at least as many bits as its set has members, so that hardly a pair under 0.74 gets
through; the larger of two is folded to the smaller one's length. All others are compared by the
sets themselves. Only what passes is a link, and groups are the components of links.

``simhashed`` comes first where a caller wants its method: each set has a SimHash fingerprint too, sets whose
fingerprints are linked are compared by the sets themselves, and pairs that this joins do not meet again. The
prefix filter then covers what fingerprints leave apart, so that the groups are exact.

As in ``simhash``, pairs within a key's group are not enumerated: every member is compared with
one leader first, then, in a few turns, those outside the group's largest component with one member of
it a key, and only what is still outside meets the rest in full, across components, at the first key
that they share. Pairs left out are within one component already. Of the leaders that a text may be like,
the likeliest is compared first and the others only if that leaves them apart.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, release, small_batches

SEED = 42
#: Longs of the shortest parity bitmap, to which all are folded where keys meet. It tells unlike
#: sets of up to about 4600 shingles apart; pairs of longer ones wait for their whole bitmaps.
WORDS = 32
#: Texts by which shingles are told rare, how often one must occur there to count as frequent, and
#: how many frequent ones travel with the tasks at most.
SAMPLE, FREQUENT, MOST = 10_000, 3, 50_000
#: Keys of a member by which pairs that have met before are told.
EARLIER = 64
#: Turns in which components are joined by single links before the rest meets in full.
TURNS = 3
#: Bits of a fingerprint in which linked ones differ at most, as in operator 3.
DISTANCE = 3
#: Up to so many rows of two numbers are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every distinct run of ``width`` words (A-Z lower-cased, split at ASCII white space),
    ascending; of the whole if there are fewer words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if len(words) < width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, len(shingles)))


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def parity_bitmap(h: np.ndarray) -> np.ndarray:
    """A power of two of longs, at least ``WORDS``, with a bit or more for each hash."""
    bits = 64 * WORDS
    while bits < len(h):
        bits *= 2
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bitmap: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The parity bitmap of ``words`` longs of the same set: bits that meet are added."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.array([], np.int64)))


def frequent_shingles(docs: DataFrame, id_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of at most ``MOST`` shingles that are frequent in a sample."""

    def run(batches):
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, width).view(np.int64))], names=["h"])
            release()

    share = min(1.0, SAMPLE / max(docs.count(), 1))
    some = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counted = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.desc("n"), "h").limit(MOST).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["n"] for r in rows], np.int64)[order]


def _sketches(docs: DataFrame, id_col: str, carry: list[str], width: int, similarity: float) -> DataFrame:
    """(id, ``carry``, digest of the set, n shingles, fold, bitmap, keys, fp) of every text; ``bitmap`` is
    null where it is no longer than ``fold``, and ``fp`` is the set's SimHash fingerprint."""
    from .simhash import fingerprint_bits, pack

    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, id_col, width))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in (id_col, *carry)])
    schema = schema.add("digest", "binary").add("size", T.IntegerType()).add("fold", longs).add("bitmap", longs).add("keys", longs).add("fp", T.LongType())

    def run(batches):
        import xxhash

        known, counts = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                digests, sizes, folds, maps, keys, prints = [], [], [], [], [], []
                for t in batch.column("text").to_pylist():
                    h = shingle_set(t, width)
                    often = np.zeros(len(h), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        often = np.where(known[at] == h, counts[at], 0)
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sizes.append(len(h))
                    bitmap = parity_bitmap(h)
                    folds.append(folded(bitmap))
                    maps.append(bitmap.tolist() if len(bitmap) > WORDS else None)
                    # the sort is stable and the hashes ascend: rare ones first, equal ones by hash
                    keys.append(h[np.argsort(often, kind="stable")[: prefix_length(len(h), similarity)]].view(np.int64))
                    prints.append(int(pack(fingerprint_bits(h))[0]))
                columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), _lists(folds), pa.array(maps, pa.list_(pa.int64())), _lists(keys), pa.array(prints, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, *carry)), *columns], names=schema.fieldNames())
            release()

    return docs.select(id_col, *carry, "text").mapInArrow(run, schema)


def _apart(a: Column, b: Column) -> Column:
    """Bits that differ in two bitmaps of ``WORDS`` longs."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WORDS)), F.lit(0))


def _apart_long(a: Column, b: Column) -> Column:
    """Bits that differ in two bitmaps, the longer one folded: sizes of two sets that may be near
    differ by a quarter at most, so it is at most twice as long."""
    n = F.least(F.size(a), F.size(b))
    fit = lambda x: F.when(F.size(x) == n, x).otherwise(
        F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))
    )
    return F.aggregate(F.zip_with(fit(a), fit(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def _most(na: Column, nb: Column, similarity: float) -> Column:
    """Shingles in which sets of these sizes may differ at most."""
    return (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _sizes_fit(na: Column, nb: Column, similarity: float) -> Column:
    return F.least(na, nb) >= F.greatest(na, nb) * similarity - 1e-6


def _possible(pairs: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """(a, b, gap) of the pairs that sizes and bitmaps do not show to be below the threshold;
    ``gap`` is smaller for likelier ones."""
    end = lambda x: of.select(F.col("u").alias(x), F.col("size").alias(f"n{x}"), F.col("fold").alias(f"f{x}"), F.col("bitmap").alias(f"m{x}"))
    na, nb, most = F.col("na"), F.col("nb"), _most(F.col("na"), F.col("nb"), similarity)
    both = pairs.join(end("a"), "a").join(end("b"), "b").filter(_sizes_fit(na, nb, similarity) & (_apart("fa", "fb") <= most))
    full = lambda x: F.coalesce(F.col(f"m{x}"), F.col(f"f{x}"))
    both = both.withColumn("apart", F.when(F.col("ma").isNull() & F.col("mb").isNull(), _apart("fa", "fb")).otherwise(_apart_long(full("a"), full("b"))))
    return both.filter(F.col("apart") <= most).select("a", "b", (F.col("apart") / F.greatest(na + nb, F.lit(1))).alias("gap"))


def _verified(scratch: Scratch, pairs: DataFrame, distinct: DataFrame, docs: DataFrame, id_col: str, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity. Texts are moved, which are smaller than
    their sets, and those of pairs only."""
    schema = T.StructType().add("a", "long").add("b", "long")

    def run(batches):
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                a, b = shingle_set(ta, width), shingle_set(tb, width)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common * (1 + similarity) >= (len(a) + len(b)) * similarity - 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            release()

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    needed = scratch.keep(distinct.select("u", id_col).join(nodes, "u"), "needed")
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    texts = scratch.keep(docs.select(id_col, "text").join(few, id_col).select("u", "text"), "texts")
    end = lambda x: texts.select(F.col("u").alias(x), F.col("text").alias(f"t{x}"))
    out = scratch.keep(pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, schema), "links")
    scratch.drop(needed, texts)
    return out


def simhashed(scratch: Scratch, distinct: DataFrame, docs: DataFrame, id_col: str, width: int, similarity: float) -> DataFrame:
    """(a, b): links that SimHash finds. Fingerprints are grouped as in operator 3 (tables of blocks, ``DISTANCE`` bits),
    and each member's set is compared with that of its group's first one."""
    from .simhash import block_tables, near_groups

    def key(table: np.ndarray) -> Column:
        """The bits of a table's blocks, in their places: one number for equal bits."""
        return F.col("fp").bitwiseAND(F.lit(int(np.bitwise_or.reduce(np.uint64(1) << table.astype(np.uint64)).view(np.int64))))

    prints = distinct.select(F.col("u").alias("id"), F.array("fp").alias("fp"), F.array(*map(key, block_tables(64, DISTANCE, 2))).alias("keys"))
    found = near_groups(prints, 1, DISTANCE).filter("id <> component_id").select(F.col("component_id").alias("a"), F.col("id").alias("b"))
    pairs = scratch.keep(_possible(found, distinct.select("u", "size", "fold", "bitmap"), similarity), "simhash")
    return _verified(scratch, pairs, distinct, docs, id_col, width, similarity)


def _meetings(scratch: Scratch, members: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of ``members`` (key, main, u, pos, label) of one key but of different labels, one of them not the
    key's main one, that sizes, places and folded bitmaps (``of``: u, size, fold) do not show to be too far apart.

    A pair meets at the first key that it shares and nowhere else: each member carries the keys before this one, in the
    common order. They are cut off at ``EARLIER``; a pair whose first one lies beyond may come out again.
    """
    members = scratch.keep(members, "members")
    head = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]), 1, EARLIER).alias("head")
    place = F.array_position("head", F.col("key")).cast("int")
    earlier = F.when(place > 0, F.slice("head", F.lit(1), F.greatest(place, F.lit(1)) - 1)).otherwise(F.col("head"))
    placed = members.join(members.groupBy("u").agg(head), "u").select("key", "main", "u", "pos", "label", earlier.alias("earlier"))
    placed = scratch.keep(placed.join(of, "u"), "placed")
    side = lambda x: [F.col(c).alias(f"{c[0]}{x}") for c in ("label", "pos", "size", "fold", "earlier")]
    a = placed.filter("label <> main").select("key", F.col("u").alias("a"), *side("a"))
    b = placed.select("key", "main", F.col("u").alias("b"), *side("b"))
    across = (F.col("la") != F.col("lb")) & ((F.col("la") < F.col("lb")) | (F.col("lb") == F.col("main")))
    # the first shingle that a pair has in common leaves room in both sets for all that must follow it
    common = (F.col("sa") + F.col("sb")) * (similarity / (1 + similarity)) - 1e-6
    room = (F.col("sa") - F.col("pa") >= common) & (F.col("sb") - F.col("pb") >= common)
    fits = room & _sizes_fit(F.col("sa"), F.col("sb"), similarity) & (_apart("fa", "fb") <= _most(F.col("sa"), F.col("sb"), similarity))
    return a.join(b, "key").filter(across & fits & ~F.arrays_overlap("ea", "eb")).select("a", "b")


def _labelled(scratch: Scratch, large: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, members): members of ``large`` whose key has several components, as (key, main, mains, u, pos, label), and the
    table of ``scratch`` that they are read from. ``main`` is the component with most members of the key, ``mains`` their number."""
    rows = scratch.keep(large.join(label.withColumnRenamed("node", "u"), "u", "left").select("key", "u", "pos", F.coalesce("component", "u").alias("label")), "labelled")
    main = (
        rows.groupBy("key", "label").agg(F.count("*").alias("c"))
        .groupBy("key").agg(F.max_by(F.struct(F.col("label").alias("main"), F.col("c").alias("mains")), F.struct("c", "label")).alias("m"), F.count("*").alias("labels"))
        .filter("labels > 1").select("key", "m.*")
    )
    return rows, rows.join(main, "key").select("key", "main", "mains", "u", "pos", "label")


def _bridges(sized: DataFrame, of: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b) from members with their sizes and folds: for every one outside the main component of a key, and for each main
    component that it meets so, the likeliest partner among one member of it a key, drawn anew with each ``turn``.

    Two large components of one crowd have links by the product of their sizes, of which one is enough; so the join makes at
    most a row for each member of a key, where meeting in full would make them all.
    """
    drawn = F.min_by(F.struct("u", "size", "fold"), F.xxhash64("u", "key", F.lit(turn)))
    ends = sized.filter("label = main").groupBy("key").agg(drawn.alias("e")).select("key", F.col("e.u").alias("b"), F.col("e.size").alias("sb"), F.col("e.fold").alias("fb"))
    most = _most(F.col("size"), F.col("sb"), similarity)
    fits = _sizes_fit(F.col("size"), F.col("sb"), similarity) & (_apart("fold", "fb") <= most)
    met = sized.filter("label <> main").join(ends, "key").filter(fits)
    gap = _apart("fold", "fb") / F.greatest(F.col("size") + F.col("sb"), F.lit(1))
    best = met.groupBy(F.col("u").alias("a"), "main").agg(F.min_by("b", F.struct(gap, "b")).alias("b"))
    return _possible(best.select("a", "b"), of, similarity).select("a", "b")


def nodes(scratch: Scratch, docs: DataFrame, id_col: str, carry: list[str], rank: Column, width: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, distinct, label), tables of ``scratch``: each row with the digest of its set; one row
    (u, digest, and the columns of its first row by ``rank``) for each distinct set; and
    (node, component) for those that have a link."""
    small_batches(docs.sparkSession)
    prints = scratch.keep(_sketches(docs, id_col, carry, width, similarity), "prints")
    # one row for each distinct set, numbered once and for all by being written
    fields = [id_col, *carry, "size", "fold", "bitmap", "keys", "fp"]
    one = prints.groupBy("digest").agg(F.min_by(F.struct(*fields), rank).alias("s"))
    distinct = scratch.keep(one.select("digest", "s.*", F.monotonically_increasing_id().alias("u")), "distinct")
    # a key among the first ones of the smaller set is the only kind that a pair needs
    indexed = F.col("pos") <= F.col("size") - F.ceil(F.col("size") * (2 * similarity / (1 + similarity)) - 1e-9)
    rows = distinct.select("u", "size", F.posexplode("keys").alias("pos", "key")).select("key", "u", "pos", indexed.alias("i"))
    shared = scratch.keep(
        rows.groupBy("key")
        .agg(F.count("*").alias("c"), F.min(F.when(F.col("i"), F.col("u"))).alias("leader"), F.min("u").alias("lo"), F.max("u").alias("hi"))
        .filter("c > 1 AND leader IS NOT NULL"),
        "shared",
    )
    leaders = shared.filter("c > 2").select("key", "leader")
    large = scratch.keep(rows.join(F.broadcast(leaders) if leaders.count() <= BROADCAST_ROWS else leaders, "key"), "large")
    of = distinct.select("u", "size", "fold", "bitmap")
    stars = (
        shared.filter("c = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        .unionByName(large.filter("u <> leader").select(F.col("leader").alias("a"), F.col("u").alias("b")))
        .distinct()
    )
    met = simhashed(scratch, distinct, docs, id_col, width, similarity)
    known = scratch.keep(connected_components(scratch, met), "known")
    of_known = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"l{x}"))
    apart = stars.join(of_known("a"), "a", "left").join(of_known("b"), "b", "left").filter(~F.coalesce(F.col("la") == F.col("lb"), F.lit(False)))
    pairs = scratch.keep(_possible(apart.select("a", "b"), of, similarity), "pairs")
    likeliest = scratch.keep(pairs.groupBy("b").agg(F.min_by("a", F.struct("gap", "a")).alias("a")), "likeliest")
    links = met.unionByName(_verified(scratch, likeliest, distinct, docs, id_col, width, similarity))
    first = scratch.keep(connected_components(scratch, links), "first")

    # components of one crowd that chance has left apart are joined by single links, in turns
    label = first
    for turn in range(TURNS):
        labelled, members = _labelled(scratch, large, label)
        sized = scratch.keep(members.filter("mains > 1").join(of.drop("bitmap"), "u"), "sized")
        bridges = scratch.keep(_bridges(sized, of, similarity, turn), "bridges")
        scratch.drop(labelled, sized)
        more = _verified(scratch, bridges, distinct, docs, id_col, width, similarity)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        label = scratch.keep(connected_components(scratch, links), "joined")

    # what is still apart: pairs with other leaders, and of the large groups members outside the
    # largest component with the rest, across components
    label_of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"l{x}"))
    other = (
        pairs.select("a", "b").join(likeliest, ["a", "b"], "left_anti").join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
        .filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    )
    labelled, members = _labelled(scratch, large, label)
    crossing = _meetings(scratch, members.drop("mains"), of.drop("bitmap"), similarity).distinct()
    crossing = scratch.keep(_possible(crossing, of, similarity).select("a", "b").unionByName(other), "crossing")
    more = _verified(scratch, crossing, distinct, docs, id_col, width, similarity)
    if not more.isEmpty():
        label = scratch.keep(connected_components(scratch, links.unionByName(more)), "label")
    scratch.drop(shared, large, pairs, likeliest, labelled, crossing)
    return prints.select(id_col, *carry, "digest"), distinct, label


def groups(docs: DataFrame, id_col: str, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): the smallest id reachable over links, itself included. ``docs`` has
    ``id_col``, unique and not null, and ``text``.

    Texts without a word are copies of each other; shorter texts have their whole word sequence as
    the one shingle.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    rows, distinct, label = nodes(scratch, docs, id_col, [], F.col(id_col), width, similarity)
    named = distinct.select("u", "digest", id_col).join(label.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("component", "u"))
    smallest = named.groupBy("root").agg(F.min(id_col).alias("component_id"), F.count("*").alias("n"))
    # only digests of groups of several sets need the group's id; the others have their own least id
    named = named.join(smallest.filter("n > 1").drop("n"), "root", "left").select("digest", F.coalesce("component_id", id_col).alias("component_id"))
    return rows.join(named, "digest").select(F.col(id_col).alias("id"), "component_id")


def survivors(scratch: Scratch, docs: DataFrame, id_col: str, carry: list[str], rank: Column, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows, kept), each (``id_col``): all rows, and the first by ``rank`` of each group. ``rank`` is
    an expression over ``id_col`` and ``carry`` that has no ties."""
    rows, distinct, label = nodes(scratch, docs, id_col, carry, rank, width, similarity)
    named = distinct.select("u", id_col, *carry).join(label.withColumnRenamed("node", "u"), "u", "left")
    kept = named.groupBy(F.coalesce("component", "u")).agg(F.min_by(id_col, rank).alias(id_col)).select(id_col)
    return rows.select(id_col), kept
