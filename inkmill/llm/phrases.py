"""Phrase collocations: frequent runs of two to four words that hold together at every cut.

Counting goes by a HAT-trie. A task numbers its words and keeps, under the first word of each window of
four, a hash container of the words that follow, with counts; a container that grows over ``BURST``
entries bursts into a node with a container for each next word. Only the longest window at each position
is counted: every shorter phrase is a prefix, so its count is the sum of what stands below it. When a
task holds ``HELD`` windows, its largest subtrees are spilled whole as sorted runs. Runs are dealt out by
ranges of keys (words in order, so a range is a set of prefixes), merged in order, and each range sums
its prefixes; those that reach beyond a batch are added up afterwards. Ranges follow from the runs
themselves, so a prefix with a third of all windows spans many of them.

A window goes on only over pairs of words that may occur ``least`` times. That is told by a pass before:
pairs are counted by hash, and those of frequent hashes set bits of a filter of bounded size, which goes to
all tasks. It lets some others through and keeps none out, so counts of frequent phrases stay exact; where it
is too full to tell pairs apart, windows are longer and nothing else changes.

Only phrases that occur ``least`` times leave that step; everything after it is joins of these.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, release, small_batches

#: Words of a phrase at most.
LONGEST = 4
#: Fixed values of the contract: pieces end at these, words at spaces and tabs.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_END = bytes.maketrans(_ENDS, b"\x00" * len(_ENDS))
#: Entries of a container before it bursts; windows a task holds before it spills; tokens worked on at once.
BURST, HELD, TOKENS = 4096, 1 << 19, 1 << 18
#: Words a task numbers before it spills all and begins anew, windows that are sorted at once, pairs that are counted at once.
WORDS, SORTED, PAIRS = 1 << 18, 1 << 17, 1 << 22
#: Bits of a word's number.
BITS = 21
MASK = (1 << BITS) - 1
#: Windows of a range.
RANGE_ROWS = 1 << 20
_END = "\x00"


class _Node:
    """A burst container: by the next word, what follows it, whose words take ``shift`` bits."""

    __slots__ = ("shift", "children")

    def __init__(self, shift: int):
        self.shift, self.children = shift, {}


class HatTrie:
    """Counts of (first word, packed next words) windows."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.size = burst, {}, 0

    def add(self, first: list[int], rest: list[int], counts: list[int] | None = None) -> None:
        root = self.root
        for a, s, n in zip(first, rest, counts or itertools.repeat(1)):
            box, place, key, shift = root.get(a), root, a, (LONGEST - 1) * BITS
            while box.__class__ is _Node:
                shift, place = box.shift, box.children
                key, s = s >> shift, s & ((1 << shift) - 1)
                box = place.get(key)
            if box is None:
                place[key] = {s: n}
                self.size += 1
            elif s in box:
                box[s] += n
            else:
                box[s] = n
                self.size += 1
                if len(box) > self.burst and shift > BITS:
                    place[key] = self._burst(box, shift - BITS)

    @staticmethod
    def _burst(box: dict[int, int], shift: int) -> _Node:
        node, low = _Node(shift), (1 << shift) - 1
        for s, n in box.items():
            node.children.setdefault(s >> shift, {})[s & low] = n
        return node

    def _entries(self, tree) -> Iterator[tuple[int, dict[int, int]]]:
        """(packed words above, container) of every container of a subtree."""
        if tree.__class__ is dict:
            yield 0, tree
            return
        for word, child in tree.children.items():
            for above, box in self._entries(child):
                yield word << tree.shift | above, box

    def spill(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, rest, counts) of whole subtrees, largest first, until at most ``most`` windows are left."""
        sizes = sorted(((sum(len(b) for _, b in self._entries(t)), a) for a, t in self.root.items()), reverse=True)
        first, rest, counts = [], [], []
        for n, a in sizes:
            if self.size <= most:
                break
            for above, box in self._entries(self.root.pop(a)):
                first.append(np.full(len(box), a, np.int64))
                rest.append(np.fromiter(box.keys(), np.int64, len(box)) | above)
                counts.append(np.fromiter(box.values(), np.int64, len(box)))
            self.size -= n
        whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return whole(first), whole(rest), whole(counts)


class _Numbers(dict):
    """Numbers from 1 for words; the end of a piece is 0."""

    def __init__(self):
        super().__init__({b"\x00": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def words(self) -> pa.Array:
        return pa.array(list(self), pa.binary()).cast(pa.string())


def _tokens(text: bytes) -> list[bytes]:
    """Words, and NUL for the end of a piece. (The text has no other NUL; ends took the other white space.)"""
    return text.translate(_TO_END).replace(b"\x00", b" \x00 ").split()


def _slices(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """(tokens, n): the first n begin windows, those after them only follow. Long texts come in parts, cut at
    spaces and tabs."""
    more = LONGEST - 1
    tokens, at = [], 0
    while len(text) - at > 8 * TOKENS:
        cut = max(text.rfind(b" ", at, at + 8 * TOKENS), text.rfind(b"\t", at, at + 8 * TOKENS)) + 1
        if cut <= at:
            cut = min((x for x in (text.find(b" ", at + 8 * TOKENS), text.find(b"\t", at + 8 * TOKENS)) if x >= 0), default=len(text) - 1) + 1
        tokens += _tokens(text[at:cut])
        at = cut
        if len(tokens) > more:
            yield tokens, len(tokens) - more
            tokens = tokens[-more:]
    tokens += _tokens(text[at:] if at else text)
    yield tokens, len(tokens)


def escaped(text: bytes) -> bytes:
    """The text without NUL, which separates words in keys; order is kept."""
    return text.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if b"\x00" in text or b"\x01" in text else text


class Pairs:
    """A filter of (language, word, next word) hashes: a bitmap in which each has two bits."""

    #: Bits at least and at most, and bits for each hash in between.
    LEAST, MOST, EACH = 16, 27, 16

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @staticmethod
    def hashes(lang: np.ndarray, word: np.ndarray, following: np.ndarray) -> np.ndarray:
        h = (lang * np.uint64(0x9E3779B97F4A7C15)) ^ (word * np.uint64(0xD6E8FEB86659FD93)) ^ (following * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) & np.uint64((1 << 48) - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for place in (h & self.mask, (h >> np.uint64(21)) & self.mask):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @classmethod
    def of(cls, frequent: DataFrame) -> Pairs:
        """From (h): bits are set by an aggregation over words of the bitmap, of which the driver gets at most 2^21."""
        bits = min(max(int(frequent.count() * cls.EACH).bit_length(), cls.LEAST), cls.MOST)
        last = F.lit((1 << bits) - 1)
        places = F.explode(F.array(F.col("h").bitwiseAND(last), F.shiftright("h", 21).bitwiseAND(last))).alias("p")
        word = frequent.select(places).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS int))")).alias("b"))
        table = word.toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[table.column("w").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
        return cls(words)


class _Reader:
    """A task's numbers of words and languages, and the texts that wait to be worked on, as numbers."""

    def __init__(self):
        self.numbers, self.langs = _Numbers(), {}
        self._hashes = np.zeros(1, np.uint64)
        self._waiting: list[tuple[int, int, np.ndarray]] = []
        self._size = 0

    def add(self, lang: str | None, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, lang) when enough has come together; ``lang`` is -1 where no window begins."""
        of = self.langs.setdefault(escaped(("und" if lang is None else lang).encode()).decode(), len(self.langs))
        for tokens, n in _slices(escaped(text.encode().lower())):
            self._waiting.append((of, n, np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))))
            self._size += len(tokens)
            if self._size >= TOKENS:
                yield self.rest()

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        end = np.zeros(LONGEST, np.int64)
        ids = np.concatenate([end, *(x for _, _, t in self._waiting for x in (t, end))])
        lang = np.concatenate([np.full(LONGEST, -1), *(np.repeat([of, -1], [n, len(t) - n + LONGEST]) for of, n, t in self._waiting)])
        self._waiting, self._size = [], 0
        return ids, lang

    def full(self) -> bool:
        return len(self.numbers) > WORDS or len(self.langs) > MASK

    def forget(self) -> None:
        self.numbers, self.langs, self._hashes = _Numbers(), {}, np.zeros(1, np.uint64)

    def pair_hashes(self, ids: np.ndarray, lang: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the pairs that begin at ``at``, which follow from the words alone."""
        import xxhash

        if len(self._hashes) < len(self.numbers):
            new = list(self.numbers)[len(self._hashes) :]
            self._hashes = np.append(self._hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)))
        names = np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in self.langs), np.uint64, len(self.langs))
        return Pairs.hashes(names[lang[at]], self._hashes[ids[at]], self._hashes[ids[at + 1]])


def pair_counts(docs: DataFrame) -> DataFrame:
    """(h, c): counts of pairs of words by hash, one row for each hash and run of texts."""

    def run(batches):
        reader, held, n = _Reader(), [], 0

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 16)].view(np.int64)), pa.array(c[i : i + (1 << 16)])], names=["h", "c"])

        def hashes(ids, lang):
            at = np.flatnonzero((ids[:-1] > 0) & (lang[:-1] >= 0) & (ids[1:] > 0))
            return reader.pair_hashes(ids, lang, at)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in reader.add(lang, text) if text else ():
                    held.append(hashes(*part))
                    n += len(held[-1])
                    if n >= PAIRS:
                        yield from counted()
                        held, n = [], 0
                    if reader.full():
                        reader.forget()
        held.append(hashes(*reader.rest()))
        yield from counted()
        release()

    return docs.select(F.col("lang").cast("string"), "text").mapInArrow(run, "h long, c long")


class _Counter:
    """A task's trie, filled from what its reader has read."""

    def __init__(self, pairs: Pairs, held: int, burst: int):
        self.pairs, self.held, self.trie, self.reader = pairs, held, HatTrie(burst), _Reader()

    def count(self, ids: np.ndarray, lang: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Puts windows into the trie, and spills what is over the bound."""
        at = np.flatnonzero(ids[:-1] > 0)
        going = np.zeros(len(ids), bool)  # over the pair that begins here
        both = at[ids[at + 1] > 0]
        of = np.maximum.accumulate(np.where(lang >= 0, np.arange(len(ids)), 0))  # words that only follow are of the text before
        if len(both):
            going[both] = self.pairs.holds(self.reader.pair_hashes(ids, lang[of], both))
        at = at[lang[at] >= 0]
        rest, on = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for d in range(1, LONGEST):
            on = on & going[np.minimum(at + d - 1, len(ids) - 1)]
            rest = rest << BITS | np.where(on, ids[np.minimum(at + d, len(ids) - 1)], 0)
        first = lang[at] << BITS | ids[at]
        alone = rest == 0
        words, n = np.unique(first[alone], return_counts=True)
        self.trie.add(words.tolist(), [0] * len(words), n.tolist())
        self.trie.add(first[~alone].tolist(), rest[~alone].tolist())
        if self.trie.size > self.held:
            yield from self.runs(self.held // 2)
        if self.reader.full():
            yield from self.runs(0)
            self.reader.forget()

    def runs(self, most: int) -> Iterator[pa.RecordBatch]:
        first, rest, counts = self.trie.spill(most)
        if not len(first):
            return
        words, langs = self.reader.numbers.words(), pa.array(list(self.reader.langs), pa.string())
        for start in range(0, len(first), SORTED):
            a, s, c = first[start : start + SORTED], rest[start : start + SORTED], counts[start : start + SORTED]
            column = lambda x: words.take(pa.array(x, mask=x == 0))
            parts = [langs.take(pa.array(a >> BITS)), column(a & MASK)] + [column(s >> BITS * d & MASK) for d in range(LONGEST - 2, -1, -1)]
            key = pc.binary_join_element_wise(*parts, _END, null_handling="skip")
            order = pc.sort_indices(key)
            run = pa.RecordBatch.from_arrays([key.take(order), pa.array(c).take(order)], names=["key", "c"])
            for i in range(0, run.num_rows, 1 << 16):
                yield run.slice(i, 1 << 16)


def windows(docs: DataFrame, pairs: Pairs, held: int = HELD, burst: int = BURST) -> DataFrame:
    """(key, c): sorted runs of counted windows; a key is the language and up to four words, split by NUL."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs.words)

    def run(batches):
        counter = _Counter(Pairs(shared.value), held, burst)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in counter.reader.add(lang, text) if text else ():
                    yield from counter.count(*part)
        yield from counter.count(*counter.reader.rest())
        yield from counter.runs(0)
        del counter
        release()

    return docs.select(F.col("lang").cast("string"), "text").mapInArrow(run, "key string, c long")


def _prefix_sums(least: int):
    """Sums over the prefixes of sorted windows. A prefix inside a batch is whole, so it comes out only
    with ``least`` occurrences; one at a batch's edge may go on and comes out in any case, as does a language."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            parts = pc.split_pattern(batch.column(0), _END)
            offsets = parts.offsets.to_numpy()
            begin, length = offsets[:-1].astype(np.int64), np.diff(offsets)
            ids = parts.values.dictionary_encode().indices.to_numpy()
            counts = batch.column(1).to_numpy()
            changed = np.zeros(n, bool)
            changed[0] = True
            for depth in range(LONGEST + 1):
                there = length > depth
                word = np.where(there, ids[np.where(there, begin + depth, 0)], -1)
                changed[1:] |= word[1:] != word[:-1]
                start = np.flatnonzero(changed)
                total = np.add.reduceat(counts, start)
                edge = (start == 0) | (np.append(start[1:], n) == n)
                out = there[start] & (edge | (total >= least) | (depth == 0))
                if out.any():
                    chosen = pc.list_slice(parts.take(pa.array(start[out])), 0, depth + 1)
                    key = pc.binary_join(chosen, _END)
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.full(out.sum(), depth, np.int32)), pa.array(total[out])], names=["key", "words", "c"])

    return run


def counts(scratch: Scratch, docs: DataFrame, least: int, held: int = HELD, burst: int = BURST) -> DataFrame:
    """(key, words, c): every phrase of up to four words with ``least`` occurrences or more, and each
    language (words 0) with the number of its words."""
    hashes = pair_counts(docs).groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    frequent = scratch.keep(hashes.select("h"), "frequent")
    runs = scratch.keep(windows(docs, Pairs.of(frequent), held, burst), "runs")
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    merged = runs.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(_prefix_sums(least), "key string, words int, c long")
    out = scratch.keep(merged.groupBy("key", "words").agg(F.sum("c").alias("c")).filter((F.col("c") >= least) | (F.col("words") == 0)), "counts")
    scratch.drop(runs, frequent)
    return out


def _plain(key: Column) -> Column:
    """Text of a part of a key: separators to spaces, and NUL put back."""
    return F.replace(F.replace(F.translate(key, _END, " "), F.lit("\x01\x01"), F.lit(_END)), F.lit("\x01\x02"), F.lit("\x01"))


def _big(c: Column) -> Column:
    return c.cast("decimal(25,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, held: int = HELD, burst: int = BURST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    ``docs`` has ``lang`` (null: ``und``) and ``text``. A-Z are lower-cased, pieces end at ``.,;:!?`` and line ends,
    words lie between spaces and tabs. Candidates are phrases of two to four words inside a piece that occur
    ``least`` times (a). Cut after k words, a candidate scores floor(2000000 a / (l + r)) with the counts l and r of its
    parts; the lowest cut counts, the first one of equal ones. A candidate is dropped if a longer one that
    contains it has 0.8 of its occurrences. Order: score, a, then the phrase by UTF-8 bytes.

    Defined cases: null and empty texts have no words, and a language without words has no row; texts of any length
    are read whole (in parts, within the memory bound); repeated rows count as often as they occur; NUL in a
    word or language is kept; extra columns are ignored; empty in, empty out.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "phrases")
    found = counts(scratch, docs, least, held, burst)
    known = found.filter("words > 0").select("key", F.col("c").alias("f"))
    w = F.split("key", _END)
    join = lambda parts: F.array_join(parts, _END)
    candidates = found.filter("words > 1").select("key", F.col("words").alias("m"), F.col("c").alias("a"), w.alias("w"))
    cut = candidates.select("key", "m", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
        "key", "a", "k", join(F.slice("w", F.lit(1), F.col("k") + 1)).alias("left"),
        join(F.concat(F.slice("w", 1, 1), F.slice("w", F.col("k") + 2, F.col("m") - F.col("k")))).alias("right"),
    )
    cut = cut.join(known.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("CAST(a AS decimal(25,0)) * 2000000BD div (CAST(l AS decimal(25,0)) + CAST(r AS decimal(25,0)))")
    scored = cut.withColumn("score", score).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    # the parts of two words and more of every longer candidate
    inside = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(
            F.sequence(F.lit(2), F.col("m") - n + 2), lambda i: join(F.concat(F.slice("w", 1, 1), F.slice("w", i, n))))))
    covers = candidates.filter("m > 2").select(F.explode(inside).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    kept = scored.join(covers, "key", "left").filter(F.col("longer").isNull() | (_big(F.col("longer")) * 100 < _big(F.col("a")) * 80))
    named = kept.select(
        F.substring_index("key", _END, 1).alias("of"), _plain(F.substr("key", F.position(F.lit(_END), "key") + 1)).alias("phrase"), "a", "s.l", "s.r", "s.score"
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's best are told in parts first, so that no task sorts all of a language
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))))
    best = named.withColumn("part", salt).withColumn("rank", F.row_number().over(Window.partitionBy("of", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("of").orderBy(*order))).filter(F.col("rank") <= top)
    sizes = found.filter("words = 0").select(F.col("key").alias("of"), F.col("c").alias("n"))
    out = ranked.join(sizes, "of").select(_plain(F.col("of")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
    return out
