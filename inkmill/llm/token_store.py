"""A token store: concatenated ids with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by id, and each task encodes its range and writes segments
(texts travel, since they compress to about the size of their ids and need no table between). A segment holds the ids
of a run of documents as 16- or 32-bit little-endian integers, the run's document boundaries and its
document ids as Elias-Fano sequences with select samples, and the number of ids before it in its
range. Segments are rows of a Parquet table, which any Spark store can hold; ids of the segments
before a range are found from one small row per range.

Boundaries cost about 2 + log2(mean length) bits a document instead of 64, and ``select`` finds
boundary i from a sample and the unary code after it, of which a document of mean length takes
two or three bits. Readers get every offset from it.

Defined cases: a null text is empty and has the end id only; null ids come first, equal ids in input
order, repeated rows are separate documents; a very long text is a segment of its own (its ids must
fit a Parquet cell, 2 GB); extra columns are ignored, whatever their names; an empty table gives an
empty store, which reads as no rows.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import byte_letters, runs
from .common import Scratch
from .pieces import Splitter, WordCache, as_it_stands, tokenizer_file

_SAMPLE = 64
#: A segment is closed at so many documents or ids, whichever comes first.
SEGMENT_DOCS, SEGMENT_IDS = 4096, 2 << 20
#: Characters of text that are encoded at once.
RUN_CHARS = 16 << 20


#: The place of each set bit of a byte, lowest first.
_BIT = np.array([([b for b in range(8) if x >> b & 1] + [0] * 8)[:8] for x in range(256)], np.int64)


class EliasFano:
    """A monotone sequence of non-negative integers below 2**63.

    Each value is split at bit ``l``: the low bits are packed, the high parts are a unary bit
    vector in which value i sets bit high(i) + i. Every 64th one's position is sampled.
    """

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):  # noqa: E741
        self.n, self.l, self.low, self.high, self.samples = n, l, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        l = max(0, (top // n).bit_length() - 1) if n else 0  # noqa: E741
        bits = ((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, l, np.packbits(bits.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), ones[::_SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<IBII", self.n, self.l, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, l, a, b = struct.unpack_from("<IBII", raw)  # noqa: E741
        at = struct.calcsize("<IBII")
        return cls(n, l, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", -1, at + a + b))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.l):
            at = i * self.l + k
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: int) -> int:
        """Value i, by its sample and a scan of the bits after it."""
        at, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = (byte << 3) + (word & -word).bit_length() - 1
        return ((one - i) << self.l) | int(self._low(np.array([i]))[0])

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """Values at all of ``i``, each as by ``select``; the bytes after the samples are passed in step."""
        i = np.asarray(i, np.int64)
        at, left = self.samples[i // _SAMPLE].astype(np.int64), i % _SAMPLE
        byte = at >> 3
        word = self.high[byte] >> (at & 7).astype(np.uint8) << (at & 7).astype(np.uint8)
        beyond = np.flatnonzero(left >= np.bitwise_count(word))
        while len(beyond):
            left[beyond] -= np.bitwise_count(word[beyond])
            byte[beyond] += 1
            word[beyond] = self.high[byte[beyond]]
            beyond = beyond[left[beyond] >= np.bitwise_count(word[beyond])]
        ones = (byte << 3) + _BIT[word, left]
        return ((ones - i).astype(np.uint64) << np.uint64(self.l)) | self._low(i)

    def below(self, values: np.ndarray) -> np.ndarray:
        """How many members are below each of ``values``, by a binary search of selects."""
        low, high = np.zeros(len(values), np.int64), np.full(len(values), self.n, np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            less = self.select_many(mid) < values[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        return low


@functools.lru_cache(maxsize=2)
def _cache(path: str) -> tuple[WordCache, int]:
    """A word cache whose misses go to the tokenizers library, and the width of an id."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    splitter = Splitter(path)
    spec = tokenizer_file(path)
    vocab: dict[str, int] = spec["model"]["vocab"]
    top = max([*vocab.values(), *splitter.special.values()])
    letters = byte_letters()
    begins = np.zeros(top + 1, bool)  # tokens that begin with a space or a line break
    begins[[i for t, i in vocab.items() if t[0] in (letters[32], letters[10])]] = True

    def encode_plain(texts: list[str]):
        for e in tok.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def encode_words(words: list[str]):
        # as one text: a token that begins with white space begins a word
        for at in range(0, len(words), 512):
            some = "".join(map(as_it_stands, words[at : at + 512]))
            ids = np.array(tok.encode_batch_fast([some], add_special_tokens=False)[0].ids, "<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(begins[ids])).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True):
                yield raw[i:j]

    return WordCache(splitter, encode_words, encode_plain), 2 if top < 1 << 16 else 4


_SEGMENT = (
    "part int, segment int, before long, n_docs int, n_ids long, null_docs int, first_doc long, width int, ids binary, boundaries binary, doc_ids binary"
)


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, parts: int | None = None) -> None:
    """Writes every document's ids, each followed by ``end_id``, in ascending order of doc_id.

    ``parts`` ranges are sorted, encoded and written in parallel (default: the session's shuffle partitions).
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("at"))
    # the row's number spreads one id's repeated rows over ranges, too
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "at").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "at")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before = segment = 0
        held_ids: list[bytes] = []
        held_docs: list[int | None] = []
        lengths: list[int] = []
        size = 0
        cache, width = _cache(tokenizer)
        end = end_id.to_bytes(width, "little")

        def close():
            nonlocal before, segment, held_ids, held_docs, lengths, size
            known = np.array([d for d in held_docs if d is not None], np.int64)
            first = int(known[0]) if len(known) else 0
            gaps = known.astype(np.uint64) - np.uint64(first & (1 << 64) - 1)
            row = {
                "part": part, "segment": segment, "before": before, "n_docs": len(held_docs), "n_ids": size,
                "null_docs": len(held_docs) - len(known), "first_doc": first, "width": width, "ids": b"".join(held_ids),
                "boundaries": EliasFano.build(np.concatenate(([0], np.cumsum(lengths)))).to_bytes(),
                "doc_ids": EliasFano.build(gaps).to_bytes(),
            }
            before, segment = before + size, segment + 1
            held_ids, held_docs, lengths, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow)

        for some in runs(batches, "text", RUN_CHARS):
            ids, offsets = cache.encode(some.column("text"))
            raw, cuts = ids.astype(f"<u{width}").tobytes(), (offsets * width).tolist()
            for doc, i, j in zip(some.column("doc_id").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                n = (j - i) // width
                if held_docs and (len(held_docs) >= SEGMENT_DOCS or size + n > SEGMENT_IDS):
                    yield close()
                held_ids += (raw[i:j], end)
                held_docs.append(doc)
                lengths.append(n + 1)
                size += n + 1
        if held_docs:
            yield close()

    _arrow = pa.schema(
        [("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("null_docs", pa.int32()), ("first_doc", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("boundaries", pa.binary()), ("doc_ids", pa.binary())]
    )
    ranged.mapInArrow(write, _SEGMENT).write.parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the segments."""
    store = spark.read.schema(_SEGMENT).parquet(path)
    # one row for each range; a range's first id follows those of all ranges before it
    per_part = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = per_part.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    placed = store.join(F.broadcast(base), "part").select(
        (F.col("base") + F.col("before")).alias("start"), "n_docs", "null_docs", "first_doc", "width", "ids", "boundaries", "doc_ids"
    )

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                edges = EliasFano.from_bytes(r["boundaries"]).select_many(np.arange(r["n_docs"] + 1)).astype(np.int64)
                gaps = EliasFano.from_bytes(r["doc_ids"]).select_many(np.arange(r["n_docs"] - r["null_docs"]))
                docs = [None] * r["null_docs"] + (gaps + np.uint64(r["first_doc"] & (1 << 64) - 1)).astype(np.int64).tolist()
                raw = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4").tobytes()
                cuts = (4 * edges).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array(r["start"] + edges[:-1]),
                        pa.array(np.diff(edges)),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, input_ids) of a stated few documents: of segments that may hold one, a binary search
    of selects finds its place and two selects its boundaries. Nothing is decoded whole."""
    wanted = sorted(set(doc_ids))
    store = spark.read.schema(_SEGMENT).parquet(path).filter(F.col("first_doc") <= wanted[-1])

    def read(batches):
        ask = np.array(wanted, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                docs, edges = EliasFano.from_bytes(r["doc_ids"]), EliasFano.from_bytes(r["boundaries"])
                some = ask[ask >= r["first_doc"]]
                gaps = some.astype(np.uint64) - np.uint64(r["first_doc"] & (1 << 64) - 1)
                first, n = docs.below(gaps), docs.below(gaps + np.uint64(1))
                n -= first
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()) + r["null_docs"]
                ids = np.frombuffer(r["ids"], f"<u{r['width']}")
                lists = [ids[a:b].tolist() for a, b in zip(edges.select_many(at).tolist(), edges.select_many(at + 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, n)), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "input_ids"])

    return store.select("first_doc", "null_docs", "width", "ids", "boundaries", "doc_ids").mapInArrow(read, "doc_id long, input_ids array<long>")


def store_and_read(docs: DataFrame, tokenizer: str, parts: int | None = None) -> DataFrame:
    """Writes a store into the shared folder and returns ``read_store`` of it."""
    scratch = Scratch(docs.sparkSession, "tokens")
    path = scratch.path("store")
    write_store(docs, tokenizer, path, parts=parts)
    return read_store(docs.sparkSession, path)
