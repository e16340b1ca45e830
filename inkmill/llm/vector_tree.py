"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then put into the leaf that a descent finds.
A query goes through the tree best bin first: a priority queue holds the nodes by the inner product
of query and center plus a part of |query| times the radius (the root mean square distance of the
node's sample rows), and leaves are visited in the order in which they come off it. Both that part
and the number of visits are calibrated: the exact neighbours of a bounded set of queries are found
over all rows, visits are widened until the wanted share of them lies in visited leaves, and of a
few parts the one is taken that needs the fewest rows.

Rows of a leaf and the queries that visit it meet in blocks of bounded size, so a leaf or a query
vector with a third of all rows is many tasks. The first few leaves give each query k hits; their
worst score is a bar for the others: leaves whose bound (center product plus |query| times the
largest distance of any row) lies below it are not met at all, and the rest return only what scores
at least as high, so that hits do not grow with the number of visits. Scores are inner products in
double precision.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Children of a node, rows wanted in a leaf, rows of the sample for each leaf, and most rows of it
#: (so there are at most 12,500 leaves, and beyond 6.4 million rows leaves grow instead).
BRANCH, LEAF_ROWS, SAMPLE_PER_LEAF, SAMPLE_MOST = 8, 512, 16, 200_000
#: Bytes of the sample on the driver at most, in double precision, and leaves that a small table gets at least, if
#: each has so many rows.
SAMPLE_BYTES, LEAST_LEAVES, LEAST_ROWS = 256 << 20, 16, 16
#: Parts of the radius that calibration tries.
RADIUS_PARTS = (0.0, 0.25, 0.5, 1.0)
#: Queries whose exact neighbours calibrate the visits, and the share of them to be reached.
CALIBRATION_QUERIES, TARGET_RECALL = 200, 0.96
#: Leaves visited first; what they give is the bar for hits of the other leaves.
FIRST_LEAVES = 4
#: Rows of a leaf, and of its queries, that meet at once.
BLOCK = 2048


@dataclass
class Tree:
    """Nodes in order of creation, the root first; ``leaf`` is -1 for inner nodes. ``radius``: the
    root mean square distance of a node's sample rows; ``reach``: of each leaf, the largest of any row."""

    centers: np.ndarray
    radius: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    leaves: int
    reach: np.ndarray | None = None

    def node_of_leaf(self) -> np.ndarray:
        out = np.zeros(self.leaves, np.int64)
        for node, leaf in enumerate(self.leaf):
            if leaf >= 0:
                out[leaf] = node
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the nearest center."""
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                kids = self.children[node]
                c = self.centers[kids]
                near = (x[rows] @ c.T - (c * c).sum(1) / 2).argmax(1)
                stack += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def visits(self, q: np.ndarray, enough, part: float = 0.0) -> list[int]:
        """Leaves in best-bin-first order until ``enough(leaves so far)``."""
        scores = self.centers @ q + part * np.linalg.norm(q) * self.radius
        queue, out = [(-scores[0], 0)], []
        while queue and not enough(out):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(queue, (-scores[kid], kid))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centers.T - (centers * centers).sum(1) / 2).argmax(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers, (x @ centers.T - (centers * centers).sum(1) / 2).argmax(1)


def build(sample: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 5) -> Tree:
    """A tree of about ``leaves`` leaves: the node with the most rows is split until there are so many."""
    rng = np.random.default_rng(seed)
    centers, children, members = [sample.mean(0)], [[]], [np.arange(len(sample))]
    queue, count = [(-len(sample), 0)], 1
    while queue and count < leaves:
        n, node = heapq.heappop(queue)
        rows, k = members[node], min(branch, leaves - count + 1)
        if -n < 2 * k:
            continue
        found, own = _kmeans(sample[rows], k, rng)
        kept = [i for i in range(k) if (own == i).any()]
        if len(kept) < 2:
            continue  # equal rows
        for i in kept:
            children[node].append(len(centers))
            centers.append(found[i])
            children.append([])
            members.append(rows[own == i])
            heapq.heappush(queue, (-len(members[-1]), len(centers) - 1))
        count += len(kept) - 1
    numbers = iter(range(len(centers)))
    leaf = [-1 if kids else next(numbers) for kids in children]
    radius = [np.sqrt(((sample[rows] - c) ** 2).sum(1).mean()) for c, rows in zip(centers, members, strict=True)]
    return Tree(np.array(centers), np.array(radius), children, leaf, 1 + max(leaf))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist() if hasattr(column, "to_pylist") else list(column), np.float64)


def exact_top(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the ``k`` largest inner products for each query, ties to smaller ids, none
    below ``bar``; of rows with one id the best counts.

    A matrix product finds candidates; those near the k-th are scored again one by one, so that
    equal vectors have equal scores wherever they stand.
    """
    rough = q @ x.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    if bar is not None:
        rough[rough < (bar - 1e-9 * (1 + np.abs(np.nan_to_num(bar, neginf=0.0))))[:, None]] = -np.inf
    # so many rows hold k ids at least
    wide = k * int(np.unique(ids, return_counts=True)[1].max(initial=1))
    out = []
    for i in range(len(q)):
        r = rough[i]
        if len(r) > wide:
            kth = np.partition(r, len(r) - wide)[len(r) - wide]
            at = np.flatnonzero(r >= kth - 1e-9 * (1 + abs(kth)) if np.isfinite(kth) else np.isfinite(r))
        else:
            at = np.flatnonzero(np.isfinite(r))
        score = (x[at] * q[i]).sum(1)
        if bar is not None:
            at, score = at[score >= bar[i]], score[score >= bar[i]]
        best = np.lexsort((ids[at], -score))
        if wide > k:
            best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])]
        out.append((ids[at][best[:k]], score[best[:k]]))
    return out


_HIT = "query_id long, vec_id long, score double"


def _hits(q_ids, found) -> dict:
    n = [len(a) for a, _ in found]
    cat = lambda xs, t: np.concatenate(xs) if len(xs) else np.empty(0, t)
    return {"query_id": np.repeat(q_ids, n), "vec_id": cat([a for a, _ in found], np.int64), "score": cat([s for _, s in found], float)}


def _best(hits: DataFrame, k: int) -> DataFrame:
    # one exchange serves the grouping and the rank; a query has at most k hits a visit
    hits = hits.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, and a vector of the commonest length
    (others cannot be compared with it) that is not zero and has no null or non-finite component."""
    ok = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    some = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    sizes = some.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return some.limit(0) if sizes is None else some.filter(F.size("embedding") == sizes["d"])


def search(vectors: DataFrame, query_every: int = 20, k: int = 20, target: float = TARGET_RECALL, leaf_rows: int = LEAF_ROWS, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id is divisible by
    ``query_every``, among all rows with another id.

    Defined cases: see ``usable``; an id with several vectors asks with each of them and takes one
    place as a neighbour, with its best score; with ``k`` or fewer other ids all are returned; equal
    scores go to smaller ids; extra columns are ignored; an empty table gives an empty result.
    ``report``, if given, gets the numbers of leaves, visits and visits that the bar left.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "tree")
    rows = usable(vectors)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = rows.select(F.size("embedding").alias("d")).first()["d"]
    most = min(SAMPLE_MOST, SAMPLE_BYTES // (8 * width))
    leaves = max(1, min(most // SAMPLE_PER_LEAF, max(n // leaf_rows, min(LEAST_LEAVES, n // LEAST_ROWS))))
    share = min(1.0, max(2000, leaves * SAMPLE_PER_LEAF) / n)
    vector = rows.schema["embedding"].dataType.simpleString()
    # rows with one id and vector are in the sample as often as not, so their number is bounded too
    row_hash = F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id())
    chosen = rows.filter(F.pmod(row_hash, F.lit(1 << 30)) < int(share * (1 << 30))).toPandas()
    if not len(chosen):
        chosen = rows.limit(1).toPandas()
    tree = build(_matrix(chosen.sort_values("vec_id", kind="stable")["embedding"]), leaves)
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches):
        t = shared.value
        centers = t.centers[t.node_of_leaf()]
        for b in batches:
            x = _matrix(b.column("embedding")) if b.num_rows else np.empty((0, centers.shape[1]))
            leaf = t.assign(x)
            away = np.sqrt(((x - centers[leaf]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(away)], names=["vec_id", "embedding", "leaf", "away"])

    index = scratch.keep(rows.mapInArrow(assign, f"vec_id long, embedding {vector}, leaf int, away double"), "index")
    counts, tree.reach = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves)
    for r in index.groupBy("leaf").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect():
        counts[r["leaf"]], tree.reach[r["leaf"]] = r["n"], r["reach"]
    shared = spark.sparkContext.broadcast(tree)
    queries = index.filter(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    visits, part = _calibrate(index, queries, tree, counts, k, target)

    def plan(batches):
        t = shared.value
        nodes = t.node_of_leaf()
        for b in batches:
            ids, vectors_ = b.column("query_id").to_pylist(), b.column("q")
            at, leaves, turns, bounds = [], [], [], []
            for i, q in enumerate(_matrix(vectors_) if b.num_rows else ()):
                found = t.visits(q, lambda out: len(out) >= visits and counts[out].sum() > k, part)
                at += [i] * len(found)
                leaves += found
                turns += range(len(found))
                bounds.append(t.centers[nodes[found]] @ q + np.linalg.norm(q) * t.reach[found])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in at], pa.int64()), vectors_.take(pa.array(at, pa.int64())), pa.array(leaves, pa.int32()),
                    pa.array(turns, pa.int32()), pa.array(np.concatenate(bounds) if bounds else np.empty(0)),
                ],
                names=["query_id", "q", "leaf", "turn", "bound"],
            )

    planned = scratch.keep(queries.mapInArrow(plan, f"query_id long, q {vector}, leaf int, turn int, bound double"), "planned")
    first = F.col("turn") < FIRST_LEAVES
    hits = scratch.keep(_best(_meet(index, planned.filter(first).withColumn("bar", F.lit(float("-inf"))), counts, k), k).drop("rank"), "hits")
    bars = hits.groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n")).filter(F.col("n") == k).select("query_id", "bar")
    rest = planned.filter(~first).join(bars, "query_id", "left").na.fill({"bar": float("-inf")})
    # the slack covers rounding; a leaf left out holds nothing above the bar
    rest = scratch.keep(rest.filter(F.col("bound") + 1e-6 * (1 + F.abs("bound")) >= F.col("bar")).drop("bound", "turn"), "rest")
    if report is not None:
        asked = queries.count()
        report |= {"rows": n, "leaves": tree.leaves, "visits": visits, "radius_part": part}
        report["met"] = (planned.filter(first).count() + rest.count()) / max(asked, 1)
    return _best(hits.unionByName(_meet(index, rest, counts, k)), k).select("query_id", "rank", "vec_id", "score")


def _meet(index: DataFrame, planned: DataFrame, counts: np.ndarray, k: int) -> DataFrame:
    """The best hits of each planned visit, from products of bounded blocks of rows and queries."""
    asked = {r["leaf"]: r["n"] for r in planned.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    blocks = index.sparkSession.createDataFrame(
        [(i, int(-(-counts[i] // BLOCK)), int(-(-asked[i] // BLOCK))) for i in range(len(counts)) if counts[i] and asked.get(i)], "leaf int, cs int, qs int"
    )
    # each row of a leaf goes to one of its blocks, beside every block of the leaf's queries, and the reverse
    a = index.join(F.broadcast(blocks), "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), F.col("cs")).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("d"), "vec_id", "embedding"
    )
    b = planned.join(F.broadcast(blocks), "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int").alias("d"), "query_id", "q", "bar"
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(_hits(np.empty(0, np.int64), []))
        x, q = _matrix(left["embedding"]), _matrix(right["q"])
        ids, q_ids = left["vec_id"].to_numpy(np.int64), right["query_id"].to_numpy(np.int64)
        return pd.DataFrame(_hits(q_ids, exact_top(ids, x, q_ids, q, k, right["bar"].to_numpy(float))))

    return a.groupBy("leaf", "c", "d").cogroup(b.groupBy("leaf", "c", "d")).applyInPandas(meet, _HIT)


def brute_force(rows: DataFrame, queries: np.ndarray, q_ids: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) of the exact neighbours of a bounded set of queries."""
    shared = rows.sparkSession.sparkContext.broadcast((q_ids, queries))

    def run(batches):
        q_ids, q = shared.value
        for b in batches:
            if b.num_rows:
                x, ids = _matrix(b.column("embedding")), np.array(b.column("vec_id").to_pylist(), np.int64)
                yield pa.RecordBatch.from_pydict(_hits(q_ids, exact_top(ids, x, q_ids, q, k)))

    return _best(rows.select("vec_id", "embedding").mapInArrow(run, _HIT), k)


def _calibrate(index: DataFrame, queries: DataFrame, tree: Tree, counts: np.ndarray, k: int, target: float) -> tuple[int, float]:
    """The fewest visits that reach ``target`` of the exact neighbours of a bounded set of queries,
    and the part of the radius with which they meet the fewest rows."""
    n = queries.count()
    if not n or tree.leaves == 1:
        return 1, 0.0
    share = min(1.0, CALIBRATION_QUERIES / n)
    drawn = F.pmod(F.xxhash64("query_id", "q", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30))
    some = queries.filter(drawn).dropDuplicates(["query_id"]).toPandas()
    if not len(some):
        some = queries.limit(CALIBRATION_QUERIES).dropDuplicates(["query_id"]).toPandas()
    q, q_ids = _matrix(some["q"]), some["query_id"].to_numpy(np.int64)
    exact = brute_force(index, q, q_ids, k).join(index.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()
    best = None
    for part in RADIUS_PARTS:
        paths = {i: tree.visits(v, lambda out: False, part) for i, v in zip(q_ids.tolist(), q, strict=True)}
        order = {i: {leaf: j for j, leaf in enumerate(p)} for i, p in paths.items()}
        needed = np.sort([order[r["query_id"]][r["leaf"]] + 1 for r in exact])
        visits = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else 1
        cost = sum(counts[p[:visits]].sum() for p in paths.values())
        if best is None or cost < best[0]:
            best = cost, visits, part
    return best[1:]
