"""Byte-pair encoding and decoding with a pair occurrence index.

Texts are split into pieces, and all distinct pieces of a run of documents in a partition are laid
out as one array of symbols with left and right links. The index maps the rank of each adjacent
pair to all its positions. Active ranks are applied in ascending order, every occurrence of a pair
at once; the pairs that a merge makes or breaks next to it are added to the lists of their ranks
(broken ones are recognised and passed over when their rank's turn comes). No data leaves the
partition: there is no shuffle, and memory is bounded by a batch (``common.BATCH_BYTES``) plus one document.

Defined cases: a null text counts as empty and has no tokens; a null id is returned as it is;
repeated rows give repeated rows; very long texts form runs of their own; an empty table gives an
empty result; extra columns are ignored, or carried where ``keep`` names them.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import release, small_batches
from .pieces import Splitter, WordCache, special_tokens, tokenizer_file

#: Characters of text that share one pair occurrence index, and words of a generation of the cache: both are held by each worker of an executor.
RUN_CHARS, CACHED_WORDS = 1 << 20, 60_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for
    itself, the rest follow from U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


class PairIndexBpe:
    """Merge tables of a byte-level BPE file, and the encoder and decoder over them."""

    def __init__(self, path: str):
        spec = tokenizer_file(path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.base = len(vocab) + 2  # one more symbol than any id, for the ends of pieces
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order
        self.left, self.right, self.made = left, right, made
        back = {c: b for b, c in letters.items()}
        size = max([*vocab.values(), *special_tokens(path).values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in special_tokens(path).items():
            self.bytes_of[i] = token.encode()

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it does not merge."""
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of_key[at], -1)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(raw) else 0
        if not n:
            return [b""] * len(raw)
        edge = self.base - 1
        sym = np.empty(n + 1, np.int64)
        sym[:n] = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        sym[n] = edge
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        full = lengths > 0
        after[ends[full] - 1] = n
        before[(ends - lengths)[full]] = n
        after[n] = before[n] = n

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            ranks = self._ranks(sym[at], sym[after[at]])
            hit = ranks >= 0
            at, ranks = at[hit], ranks[hit]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            heads = ranks[np.concatenate(([0], cuts))].tolist()
            for rank, part in zip(heads, np.split(at, cuts) if len(cuts) else [at], strict=True):
                held = index.get(rank)
                if held is None:
                    index[rank] = [part]
                    heapq.heappush(active, rank)
                else:
                    held.append(part)

        add(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            nxt = after[at]
            good = (sym[at] == a) & (sym[nxt] == b)  # a list may hold places that other merges changed
            if not good.all():
                at = at[good]
            if not len(at):
                continue
            if a == b:
                # in a run of one symbol every second pair merges, from the left
                at = _distinct(at)
                chained = np.zeros(len(at), bool)
                chained[1:] = after[at[:-1]] == at[1:]
                starts = np.flatnonzero(~chained)
                run = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
                at = at[run % 2 == 0]
            elif len(lists) > 1:
                at = _distinct(at)
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.made[rank]
            sym[gone] = -1
            after[at] = beyond
            before[beyond] = at
            before[n] = n
            near = before[at]
            near = near[near < n]
            add(_distinct(np.concatenate((near, at))) if len(near) else at)

        alive = sym[:n] >= 0
        ids = sym[:n][alive].astype("<u4").tobytes()
        upto = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))].tolist()
        return [ids[4 * i : 4 * j] for i, j in zip(upto[:-1], upto[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def coder(path: str) -> tuple[PairIndexBpe, WordCache]:
    """One coder per process. Equal pieces of different words are indexed once in each run."""
    bpe, splitter = PairIndexBpe(path), Splitter(path)

    def encode_split(split: list[list[str]]) -> list[bytes]:
        pieces = list(set().union(*split))
        ids = dict(zip(pieces, bpe.encode_pieces(pieces), strict=True))
        return [b"".join(map(ids.__getitem__, p)) for p in split]

    return bpe, WordCache(
        splitter,
        lambda words: encode_split(splitter.pieces_of_words(words)),
        lambda texts: encode_split([splitter.pieces(t) for t in texts]),
        CACHED_WORDS,
    )


def runs(batches: Iterable[pa.RecordBatch], column: str, chars: int = RUN_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about ``chars`` of text (null: empty) or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + chars, "right")))
            yield batch.slice(start, end - start)
            start = end
        del batch  # or it would be held while the next one is read
        release()


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens and input_ids (array of int) of every document."""
    schema = T.StructType([docs.schema[c] for c in keep]).add("n_tokens", "long").add("input_ids", T.ArrayType(T.IntegerType()))
    wanted = list(dict.fromkeys([*keep, text]))

    def run(batches):
        _, cache = coder(tokenizer)
        for batch in runs(batches, text):
            ids, offsets = cache.encode(batch.column(text))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.diff(offsets)), lists],
                names=schema.fieldNames(),
            )
            del batch

    small_batches(docs.sparkSession, RUN_CHARS)
    return docs.select(*wanted).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "input_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the decoded ``text``; null ids decode to the empty text."""
    schema = T.StructType([encoded.schema[c] for c in keep]).add("text", "string")
    wanted = list(dict.fromkeys([*keep, ids]))

    def run(batches):
        bpe, _ = coder(tokenizer)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=schema.fieldNames())

    return encoded.select(*wanted).mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from those ids."""
    schema = T.StructType([docs.schema["doc_id"]]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        bpe, cache = coder(tokenizer)
        for batch in runs(batches, "text"):
            ids, offsets = cache.encode(batch.column("text"))
            each = np.split(ids, offsets[1:-1])
            decoded = (bpe.decode(x) for x in each)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                ],
                names=schema.fieldNames(),
            )
            del batch

    small_batches(docs.sparkSession, RUN_CHARS)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
