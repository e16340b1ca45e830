"""A keyword index in segments, and BM25 search that leaves most postings unscored, exactly.

Units are dealt into buckets of about ``BUCKET``, by classes of length, in which weights differ less. A block holds a term's postings
within a bucket, with the greatest term frequency and the least length in it. The greatest weight of a block follows from those for any
average length, so segments that are appended later do not make blocks stale. Counts of units and terms are
added up over segments when a search begins; an append writes its own units alone.

Postings name units by their place in the bucket, whose own row (of no term) has the keys and lengths. All of a bucket is dealt
to one task, when it is written and when it is searched, so texts, blocks and a bucket's hits are exchanged, never single scores.

A search of many queries at once:

1. every block of a query's terms gets its greatest contribution, without reading postings;
2. the buckets in which these add up to most are scored first; the k-th best score there is a bar that the k-th
   score of all cannot be below;
3. in each other bucket, terms whose greatest contributions add up to less than the bar cannot bring a unit in by
   themselves: only the others are scored, and none in buckets whose whole sum is below the bar;
4. units whose sum so far and what the left-out terms may add reach the bar get those terms' weights, too.

Where a query has a term of negative weight (one in over half the units of a small set) the bar is 0, and all is scored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.tokens import tokenize
from ..shared import new_folder
from ..sources.committed import CommittedTable, Snapshot
from .retrieval import EPSILON, K1, KEYWORD_TOP, PLACES, B, _top

#: Units of a bucket, about, and its words: a block of a frequent term is so long at most, and there are far fewer blocks than postings.
BUCKET, BUCKET_WORDS = 1024, 1 << 20
#: Units that are scored first, for each hit wanted, in so many buckets at least.
TRIED, TRIED_BUCKETS = 32, 4
#: Words of a task that makes blocks, about.
TASK_WORDS = 4_000_000
#: Up to so many rows of query terms (under 100 bytes each) are broadcast.
BROADCAST_TERMS = 200_000


def weight(tf: Column, dl: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


@dataclass
class Hits:
    """``hits``: query_id, key, rank, score. ``counts``: query_id, postings of its terms, postings that were scored."""

    hits: DataFrame
    counts: DataFrame


class SegmentedIndex:
    """A keyword index under ``path``. ``key``: Spark DDL of the columns that name a unit."""

    def __init__(self, spark: SparkSession, path: str, key: str, bucket: int = BUCKET):
        self.spark, self.bucket = spark, bucket
        fields = T.StructType.fromDDL(key)
        self.key = fields.fieldNames()
        unit = f"struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in fields)},dl:int>"
        self.table = CommittedTable(spark, path, f"term string, segment string, bucket long, n long, tf int, dl int, units array<int>, tfs array<int>, keys array<{unit}>")

    def _parts(self, words: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-words // TASK_WORDS))

    # --- segments

    def _blocks(self, tokens: DataFrame) -> tuple[DataFrame, int, int]:
        """Blocks of units (key, dl, terms) as a segment of their own, and how many units and words there are."""
        length = F.floor(F.log2(F.greatest("dl", F.lit(1))) * 8).cast("int")
        # a row for each class of length, of which there are a few hundred
        sizes = tokens.groupBy(length.alias("c")).agg(F.count("*").alias("n"), F.sum("dl").alias("words")).collect()
        n, words = sum(r["n"] for r in sizes), sum(r["words"] for r in sizes)
        most = {r["c"]: max(-(-r["n"] // self.bucket), -(-r["words"] // BUCKET_WORDS)) for r in sizes}
        counts = F.create_map(*[F.lit(x) for c, m in most.items() for x in (c, m)]) if most else F.create_map(F.lit(0), F.lit(1))
        place = F.shiftleft(length.cast("long"), 40) + F.pmod(F.xxhash64(*self.key), F.coalesce(counts[length], F.lit(1)))
        dealt = tokens.withColumn("bucket", place).repartition(self._parts(words), "bucket")
        return dealt.groupBy("bucket").applyInArrow(_blocks_of(self.key, uuid.uuid4().hex), self.table.schema), n, words

    @staticmethod
    def _has(at: Snapshot, batch: str) -> bool:
        return any(batch in p["batches"] for p in at.parts)

    def append(self, units: DataFrame, text: str = "text", batch: str | None = None) -> int:
        """Adds units (key, text) as a segment and returns how many. A unit that is added again is another unit; a
        ``batch`` name that has been committed before is not added again."""
        if batch is not None and self._has(self.table.snapshot(), batch):
            return 0
        folder = new_folder(self.spark, "tokens")
        terms = tokenize(F.coalesce(F.col(text), F.lit("")))
        units.select(*self.key, terms.alias("terms")).withColumn("dl", F.size("terms")).write.parquet(folder)
        blocks, n, total = self._blocks(self.spark.read.parquet(folder))
        part = self.table.write_part(blocks, units=n, total=total, batches=[batch] if batch else [])
        while True:
            base = self.table.snapshot()
            if batch is not None and self._has(base, batch):
                return 0
            if self.table.commit(base, [*base.parts, part]):
                return n

    def compact(self, units_below: int = 1_000_000) -> int:
        """Merges segments of fewer units into one with full blocks, and returns how many there were."""
        base = self.table.snapshot()
        small = [p for p in base.parts if p["units"] < units_below]
        if len(small) < 2:
            return 0
        batches = [b for p in small for b in p["batches"]]
        full = [p for p in small if p["units"]]
        if len(full) < 2:  # segments without units leave nothing to write
            whole = (full or small)[0] | {"batches": batches}
        else:
            words = sum(p["total"] for p in full)
            whole = self.table.write_part(self._merged(self.table._read(full), self._parts(words)), units=sum(p["units"] for p in full), total=words, batches=batches)
        gone = {p["folder"] for p in small}
        while gone <= {p["folder"] for p in base.parts}:
            if self.table.commit(base, [*(p for p in base.parts if p["folder"] not in gone), whole]):
                return len(small)
            base = self.table.snapshot()
        return 0

    def _merged(self, rows: DataFrame, parts: int) -> DataFrame:
        """Buckets of a class of length are laid one behind the other, and their blocks of one term joined."""
        bucket, size = F.col("bucket"), self.bucket
        behind = Window.partitionBy("c").orderBy("segment", "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        old = rows.filter("term IS NULL").select("segment", "bucket", "n", F.shiftright(bucket, 40).alias("c")).withColumn("from", F.sum("n").over(behind) - F.col("n"))
        old = old.withColumn("new", F.shiftleft("c", 40) + F.floor(F.col("from") / size))
        first = F.min("from").over(Window.partitionBy("new"))
        old = old.select("segment", "bucket", "new", (F.col("from") - first).cast("int").alias("shift"))
        moved = rows.join(F.broadcast(old), ["segment", "bucket"]).withColumn("units", F.transform("units", lambda u: u + F.col("shift"))).repartition(parts, "new")
        p = F.array_sort(F.collect_list(F.struct("shift", "units", "tfs", "keys")))
        out = moved.groupBy("term", F.col("new").alias("bucket")).agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"), p.alias("p"))
        return out.select("term", F.lit(uuid.uuid4().hex).alias("segment"), "bucket", "n", "tf", "dl", *[F.flatten(F.col(f"p.{c}")).alias(c) for c in ("units", "tfs", "keys")])

    # --- search

    def search(self, queries: DataFrame, k: int = KEYWORD_TOP, only: tuple[str, str] | None = None, tried: int = TRIED) -> Hits:
        """Up to ``k`` units with a score above zero for each query (query_id, query), as ``retrieval.keyword_search``
        ranks them. ``only`` is a (query column, key column) pair that must be equal; statistics stay those of all units."""
        spark, key = self.spark, self.key
        at = self.table.snapshot()
        rows = self.table.read(at)
        blocks = rows.filter("term IS NOT NULL")
        n, total = sum(p["units"] for p in at.parts), sum(p["total"] for p in at.parts)
        average = total / n if n else 1.0
        wanted = [F.col(only[0]).alias("_only")] if only else []
        also = ["_only"] * bool(only)
        asked = queries.select("query_id", *wanted, F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", *also, "term").agg(F.count("*").alias("qf"))
        raw = blocks.groupBy("term").agg(F.sum("n").alias("df")).select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw").alias("mean"))
        folder = new_folder(spark, "search")

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
        terms = kept(asked.join(raw, "term").crossJoin(F.broadcast(mean)).withColumn("w", F.col("qf") * idf).drop("raw", "mean", "qf"), "terms")
        small = (lambda df: F.broadcast(df)) if terms.count() <= BROADCAST_TERMS else (lambda df: df)
        most = weight(F.col("tf"), F.col("dl"), F.lit(average))
        meta = kept(
            blocks.select("term", "segment", "bucket", "n", most.alias("most")).join(small(terms), "term")
            .select("query_id", *also, "term", "segment", "bucket", "n", "w", F.greatest(F.col("w") * F.col("most"), F.lit(0.0)).alias("ub")),
            "blocks",
        )
        of_terms = blocks.join(small(terms.select("term").distinct()), "term", "left_semi").unionByName(rows.filter("term IS NULL"))
        of_terms = of_terms.select("segment", "bucket", "term", "units", "tfs", "keys")
        fields = [queries.schema["query_id"], T.StructField("segment", T.StringType()), *(f for f in self.table.schema["keys"].dataType.elementType if f.name != "dl")]
        schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("scored", T.LongType())])
        parts, place = self._parts(0), ["segment", "bucket"]
        meet = _scorer(key, average, k, only and only[1])

        def scored(some: DataFrame, these: DataFrame, name: str) -> DataFrame:
            """Of each bucket, the units that may be hits of ``these`` (query_id, place, term, w, ub, bar), and a row for each
            query with how many postings were scored. The number of partitions is explicit because the work outgrows the rows."""
            dealt = [df.repartition(parts, *place).groupBy(*place) for df in (some, these)]
            return kept(dealt[0].cogroup(dealt[1]).applyInArrow(meet, schema), name)

        # the bar: the k-th best score in the buckets with the greatest bounds
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("whole"), *place))
        whole = meta.groupBy("query_id", *place).agg(F.sum("ub").alias("whole"))
        early = kept(whole.withColumn("place", best).filter(F.col("place") <= max(TRIED_BUCKETS, -(-tried * k // self.bucket))).select("query_id", *place), "early")
        some = of_terms.join(small(early.select(*place).distinct()), place, "left_semi")
        first = scored(some, meta.join(small(early), ["query_id", *place], "left_semi").withColumn("bar", F.lit(0.0)), "first")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        kth = first.filter("score IS NOT NULL").withColumn("place", best).filter(F.col("place") == k).select("query_id", (F.col("score") * (1 - 1e-9)).alias("bar"))
        least = terms.groupBy("query_id").agg(F.min("w").alias("least"))
        bars = kept(least.join(kth, "query_id", "left").select("query_id", F.when(F.col("least") >= 0, F.col("bar") - 10.0**-PLACES).alias("bar")).na.fill(0.0), "bars")

        open_ = whole.join(small(bars), "query_id").filter(F.col("whole") >= F.col("bar")).join(small(early), ["query_id", *place], "left_anti")
        rest = scored(of_terms, meta.join(open_.select("query_id", *place, "bar"), ["query_id", *place]), "rest")
        both = first.unionByName(rest)
        score = both.filter("score IS NOT NULL").groupBy("query_id", "segment", *key).agg(F.sum("score").alias("score"))
        hits = _top(score.filter("score > 0"), tuple(key), k)
        counts = meta.groupBy("query_id").agg(F.sum("n").alias("postings")).join(both.groupBy("query_id").agg(F.sum("scored").alias("scored")), "query_id", "left")
        return Hits(hits, counts.na.fill(0, ["scored"]))


def _blocks_of(key: list[str], segment: str):
    """The rows of one bucket of units (key, dl, terms). Units of one key and length are one unit."""

    def build(t: pa.Table) -> pa.Table:
        unit = np.zeros(len(t), np.int64)
        for c in (*key, "dl"):
            code = t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
            unit = np.unique(unit * (code.max() + 1) + code, return_inverse=True)[1]
        own = t.select([*key, "dl"]).take(pa.array(np.unique(unit, return_index=True)[1])).combine_chunks()
        n, lists = len(own), t["terms"].combine_chunks()
        words = lists.flatten().dictionary_encode()
        pairs = words.indices.to_numpy().astype(np.int64) * n + np.repeat(unit, pc.list_value_length(lists).to_numpy())
        pairs, tfs = np.unique(pairs, return_counts=True)
        units, tfs = (pairs % n).astype(np.int32), tfs.astype(np.int32)
        starts = np.flatnonzero(np.diff(pairs // n, prepend=-1))
        ends, m = np.append(starts, len(pairs)).astype(np.int32), len(starts)
        dl = own["dl"].to_numpy()[units]
        # a row for each term, and the bucket's own
        arrays = {
            "term": words.dictionary.cast(pa.string()).to_pylist() + [None],
            "segment": [segment] * (m + 1),
            "bucket": [t["bucket"][0].as_py()] * (m + 1),
            "n": [*np.diff(ends).tolist(), n],
            "tf": [*(np.maximum.reduceat(tfs, starts).tolist() if m else []), None],
            "dl": [*(np.minimum.reduceat(dl, starts).tolist() if m else []), None],
        }
        types = {"term": pa.string(), "segment": pa.string(), "bucket": pa.int64(), "n": pa.int64(), "tf": pa.int32(), "dl": pa.int32()}
        out = {c: pa.array(x, types[c]) for c, x in arrays.items()}
        none = pa.nulls(1, pa.list_(pa.int32()))
        for c, x in (("units", units), ("tfs", tfs)):
            out[c] = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(x)), none])
        keys = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), own.to_struct_array().combine_chunks())
        out["keys"] = pa.concat_arrays([pa.nulls(m, keys.type), keys])
        return pa.table(out)

    return build


def _scorer(key: list[str], average: float, k: int, only: str | None):
    """Steps 3 and 4 for one bucket: its blocks (term, units, tfs; keys in the row of no term) meet the terms of all queries."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        own = pc.is_null(left["term"])
        keys, left = left.filter(own)["keys"].combine_chunks().flatten(), left.filter(pc.invert(own))
        length = keys.field("dl").to_numpy()
        norm = K1 * (1 - B + B * length / average)
        ends = np.cumsum(pc.list_value_length(left["units"]).to_numpy())
        units, tfs = (left[c].combine_chunks().flatten().to_numpy() for c in ("units", "tfs"))
        weight_of = lambda at: tfs[at] * (K1 + 1) / (tfs[at] + norm[units[at]])
        blocks = {t: slice(a, b) for t, a, b in zip(left["term"].to_pylist(), [0, *ends[:-1]], ends)}
        ids = right["query_id"].combine_chunks()
        codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        ub, w, bars, names = right["ub"].to_numpy(), right["w"].to_numpy(), right["bar"].to_numpy(), right["term"].to_pylist()
        order = np.lexsort((ub, codes))
        asked, found, scores, tallies, parts = [], [], [], [], {}
        for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []:
            bar, up_to, sums = bars[rows[0]], np.cumsum(ub[rows]), np.zeros(len(length))
            free = int(np.searchsorted(up_to, bar))  # terms that cannot reach the bar together
            scored = 0
            for i in rows[free:]:
                at, name = blocks[names[i]], names[i]
                if name not in parts:
                    parts[name] = weight_of(at)
                sums[units[at]] += w[i] * parts[name]
                scored += at.stop - at.start
            may = sums + (up_to[free - 1] if free else 0.0) >= bar
            if only:
                may &= pc.fill_null(pc.equal(keys.field(only), right["_only"][int(rows[0])]), False).to_numpy(zero_copy_only=False)
            for i in rows[:free] if may.any() else []:
                at = blocks[names[i]]
                there = may[units[at]]
                u, tf = units[at][there], tfs[at][there]
                sums[u] += w[i] * (tf * (K1 + 1) / (tf + norm[u]))
                scored += len(u)
            hits = np.flatnonzero(may & (sums > 0))
            if len(hits) > k:  # with those that may tie with the k-th
                hits = hits[sums[hits] >= np.partition(sums[hits], -k)[-k] - 2 * 10.0**-PLACES]
            asked += [rows[0]] * len(hits)
            found.append(hits)
            scores.append(sums[hits])
            tallies.append((rows[0], scored))
        found, scores = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((found, np.int64), (scores, np.float64)))
        n, m = len(found), len(tallies)
        at = pa.array(np.concatenate([found, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n)
        segment = right["segment"].to_pylist()[:1] * (n + m)
        out = [ids.take(pa.array([*asked, *(i for i, _ in tallies)], pa.int64())), pa.array(segment, pa.string()), *(keys.field(c).take(at) for c in key)]
        out += [pa.array(scores.tolist() + [None] * m, pa.float64()), pa.array([None] * n + [c for _, c in tallies], pa.int64())]
        return pa.table(out, names=["query_id", "segment", *key, "score", "scored"])

    return meet
