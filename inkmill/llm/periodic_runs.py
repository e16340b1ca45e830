"""Periodic runs: stretches of words that repeat with a period, and texts with all but one period dropped.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no
neighbouring word extends, and that is long enough: at least ``SHORTEST`` words and ``TIMES`` periods.

Method, for one text at a time: its suffixes in order with their LCPs (prefix doubling), then Kruskal
over the LCPs from the longest down: suffixes next to each other in that order are united, union-find
over classes that each hold their positions in order. When two classes meet at LCP l, positions of
either that become neighbours at a distance d with (TIMES - 1) d <= l seed a run of period d. A run of
length L has its first two periods' starts as such neighbours at l = L - q exactly: a position between
them at that LCP would give the run a smaller period. So only seeds that the word before does not
extend are taken, and their l is the whole rest of the run. Only LCPs of ``SHORTEST`` - 1 and more can
seed anything.

A text is skipped if no block of consecutive repeated windows of that many words is long enough for the
nearest repetition in it, which a run implies; this is exact and drops nearly all texts without runs.
Texts lie where they are: no shuffle, and a text's work is n log n in its words.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, small_batches

#: A run has at least so many words, and so many periods.
SHORTEST, TIMES = 6, 4

RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))
#: Words of a block of an ordered set; a full one is cut in two.
_BLOCK = 512


class Positions:
    """An ordered set of numbers in blocks, so that adding one moves at most a block."""

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def _block(self, x: int) -> int:
        return max(0, bisect_left(self.heads, x + 1) - 1)

    def around(self, x: int) -> tuple[int, int]:
        """The members next below and above ``x``, which is none; -1 where there is none."""
        b = self._block(x)
        block = self.blocks[b]
        i = bisect_left(block, x)
        below = block[i - 1] if i else -1  # only the first block can begin above x
        above = block[i] if i < len(block) else self.heads[b + 1] if b + 1 < len(self.heads) else -1
        return below, above

    def add(self, x: int) -> None:
        b = self._block(x)
        block = self.blocks[b]
        insort(block, x)
        self.heads[b] = block[0]
        self.size += 1
        if len(block) > _BLOCK:
            half = len(block) // 2
            self.blocks[b : b + 1] = [block[:half], block[half:]]
            self.heads.insert(b + 1, block[half])

    def __iter__(self):
        for block in self.blocks:
            yield from block


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): starts of the suffixes in lexical order, and of each with the one before, by prefix doubling."""
    n = len(words)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    while ranks[-1].max() < n - 1:
        step = 1 << (len(ranks) - 1)
        after = np.zeros(n, np.int64)  # what lies beyond the end comes first
        if step < n:
            after[:-step] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        # windows cut off by the end differ from all others, so none of them counts as equal
        i, j = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        same = (a + lcp < n) & (b + lcp < n) & (ranks[k][i] == ranks[k][j])
        lcp += same << k
    return order, lcp


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text given by numbers for its words, in order."""
    if len(words) < SHORTEST:
        return []
    order, lcp = suffix_order(words)
    edges = np.flatnonzero(lcp >= SHORTEST - 1)
    edges = edges[np.argsort(-lcp[edges], kind="stable")].tolist()
    order, lcp, w = order.tolist(), lcp.tolist(), words.tolist()
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}
    found = []

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def seed(p: int, q: int, common: int) -> None:
        d = q - p
        if (TIMES - 1) * d <= common and common + d >= SHORTEST and (p == 0 or w[p - 1] != w[q - 1]):
            found.append((p, common + d, d))

    for e in edges:
        a, b = find(e), find(e + 1)
        large, small = classes.pop(a, None) or Positions(order[a]), classes.pop(b, None) or Positions(order[b])
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        members = list(small)
        for i, x in enumerate(members):
            below, above = large.around(x)
            # neighbours of one class have met at a greater LCP
            if below >= 0 and (i == 0 or members[i - 1] < below):
                seed(below, x, lcp[e])
            if above >= 0 and (i + 1 == len(members) or above < members[i + 1]):
                seed(x, above, lcp[e])
        for x in members:
            large.add(x)
        parent[b] = a
        classes[a] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def may_have_runs(words: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Whether each of ``texts`` texts passes the block test. ``words`` are numbers for the words of all
    of them, one text after another, ``text`` the number of the text of each word."""
    out = np.zeros(texts, bool)
    width = SHORTEST - 1
    if len(words) <= width:
        return out
    at = np.arange(len(words) - width + 1)
    at = at[text[at] == text[at + width - 1]]
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    key = text[at].astype(np.uint64)
    for i in range(width):  # equal windows of a text have equal keys; others may, which costs time only
        key = (key ^ mixed[at + i]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[:-1]] == key[order[1:]])
    start, gap = at[order[again]], at[order[again + 1]] - at[order[again]]
    by = np.argsort(start)
    start, gap = start[by], gap[by]
    if not len(start):
        return out
    new = np.concatenate(([True], (np.diff(start) != 1) | (np.diff(text[start]) != 0)))
    first = np.flatnonzero(new)
    blocks, nearest = np.diff(np.append(first, len(start))), np.minimum.reduceat(gap, first)
    out[text[start[first[(TIMES - 1) * nearest - (width - 1) <= blocks]]]] = True
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words if keep.all() else [w for w, k in zip(words, keep, strict=True) if k])


def find_runs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, runs, collapsed) of every row: all runs by start and period, and the words of the text, joined
    by single spaces, without those that a run contains after its first period.

    Words lie between ASCII white space. Defined cases: a null text, an empty one and one without a word
    have no runs and an empty ``collapsed``; texts of any length are read whole; repeated rows and ids and
    null ids are rows of their own; extra columns are ignored; empty in, empty out.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                known: dict[bytes, int] = {}
                texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
                numbers = [np.fromiter((known.setdefault(w, len(known)) for w in t), np.int64, len(t)) for t in texts]
                sizes = np.array([len(t) for t in texts], np.int64)
                passed = may_have_runs(np.concatenate(numbers), np.repeat(np.arange(len(texts)), sizes), len(texts))
                runs = [runs_of(w) if p else [] for w, p in zip(numbers, passed, strict=True)]
                named = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                out = pa.array([_collapsed(t, r).decode() for t, r in zip(texts, runs, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, arrow), out], names=schema.fieldNames())
            release()

    return docs.select(id_col, "text").mapInArrow(run, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's texts: where h = crc32(decimal id) divides by 10, the words from number a = g mod n on
    repeat the p = 1 + (n - a) div (3 + g mod 8) words there, with g = h div 10; others as they are. A
    null id is taken as an empty one."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1)).cast("long")).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    cycle = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), cycle), " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The contract's row of each text: number of runs, the longest one, digests of runs and of what is kept."""
    longest = F.element_at(
        F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("q")))), 1
    )
    best = F.when(F.size("runs") > 0, longest)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["s"].alias("start"), (-best["n"]).alias("length"), best["q"].alias("period"),
        F.floor(-best["n"] * 1000 / best["q"]).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
