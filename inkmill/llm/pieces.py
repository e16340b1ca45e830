"""Splitting texts into the pieces that a byte-level tokenizer merges within, and a word cache.

Used inside tasks. Each distinct word of a partition is encoded once; texts are then joined
from cached ids.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Where the splitting library and ``regex`` agree on letters and digits (checked for every code
#: point by a test). Texts with other characters are split by the tokenizer's own library.
_SAFE = regex.compile(
    "[\u0000-՗֐-ࢎऀ-౛ഀ-₎₠-ꟍ가-힣\U0001f300-\U0001faff]*+"
)


def tokenizer_file(path: str) -> dict:
    """The parsed tokenizer file; large, so coders keep what they need of it and not the whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or spec["post_processor"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        raise ValueError(f"{path}: only plain byte-level tokenizers are supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens must match exactly")
    return spec


@functools.lru_cache(maxsize=4)
def special_tokens(path: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in tokenizer_file(path)["added_tokens"]}


class Splitter:
    """Cuts texts into pieces by a tokenizer file's special tokens and pattern."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import pre_tokenizers

        self.special = special_tokens(path)
        self._find = regex.compile(public_tokenizers.PATTERN).findall
        self._slow = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        longest = sorted(self.special, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def by_special(self, text: str) -> list[str]:
        """Text and special tokens in turn, beginning with text."""
        return self._cut.split(text) if self._cut else [text]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if text.isascii() or _SAFE.fullmatch(text):
            return self._find(text)
        return [text[a:b] for _, (a, b) in self._slow(text)]

    def pieces_of_words(self, words: list[str]) -> list[list[str]]:
        """The pieces of ``WordCache``'s words. A piece that begins with a space or a line break
        begins a word, so all words are split as one text."""
        out: list[list[str]] = []
        for p in self.pieces("".join(map(as_it_stands, words))):
            if p[0] == " " or p[0] == "\n":
                out.append([p])
            else:
                out[-1].append(p)
        return out


def as_it_stands(word: str) -> str:
    """A word of ``WordCache`` with the white space before it."""
    return word if word[0] == "\n" else " " + word


class WordCache:
    """``encode(texts)``: the ids of all texts one after another, and where each text's begin.

    Texts are cut before single spaces and line breaks, where a piece always begins, and each
    distinct word of a batch is looked up once. ``encode_words(words)`` gets words not met before,
    to be encoded after the space or with the line break that stands before them
    (``as_it_stands``); ``encode_plain(texts)`` gets the rest: the first word of each text, and
    whole texts with longer runs of white space. Both return each string's ids as little-endian
    unsigned 32-bit bytes, and neither sees a special token.

    Words are kept in two generations: when the newer one holds ``limit`` words it becomes the
    older one, and the words that were not met since the last such change are forgotten.
    """

    def __init__(
        self,
        splitter: Splitter,
        encode_words: Callable[[list[str]], Iterable[bytes]],
        encode_plain: Callable[[list[str]], Iterable[bytes]],
        limit: int = 120_000,
    ):
        self._by_special = splitter.by_special
        self._special = {k: v.to_bytes(4, "little") for k, v in splitter.special.items()}
        self._encode_words, self._encode_plain, self._limit = encode_words, encode_plain, limit
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``texts`` (null: empty) and one more offset than there are texts."""
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        flat = words.flatten()
        coded = flat.dictionary_encode()
        distinct: list[str] = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy().copy()
        first = offsets[:-1]
        heads = flat.take(pa.array(first)).to_pylist()

        # texts that are not cut at spaces: those with special tokens, and those with an empty word or one that
        # begins with other white space, which is part of a longer run of it
        loose = np.fromiter((not w or w[0].isspace() and (w[0] != "\n" or len(w) == 1 or w[1].isspace()) for w in distinct), bool, len(distinct))
        hits = loose[at]
        hits[first] = False
        whole = np.add.reduceat(hits, first, dtype=np.int64) > 0
        for token in self._special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole).tolist():
            heads[i] = texts[i].as_py()

        # entries: the distinct words, the heads (or whole texts), and one without ids
        used = np.zeros(len(distinct), bool)
        rest = np.repeat(~whole, np.diff(offsets))
        rest[first] = False
        used[at[rest]] = True
        known = self._learn([w for w, u in zip(distinct, used.tolist(), strict=True) if u])
        entries = [known[w] if u else b"" for w, u in zip(distinct, used.tolist(), strict=True)]
        entries += self._plain(heads)
        entries.append(b"")
        at[~rest] = len(entries) - 1
        at[first] = np.arange(len(distinct), len(distinct) + n)

        # Arrow lays them out, without an array of places as long as all ids
        laid = pa.array(entries, pa.large_binary()).take(pa.array(at))
        del entries, flat, coded, distinct, words, heads, rest, hits
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1) // 4
        ids = np.frombuffer(laid.buffers()[2] or b"", "<u4", ends[-1])
        if len(known) > self._limit:
            self._old, self._new = known, {}
        return ids, ends[offsets]

    def _plain(self, texts: list[str]) -> list[bytes]:
        parts = [self._by_special(t) for t in texts]
        found = iter(self._encode_plain([p for ps in parts for p in ps[::2]]))
        return [
            next(found) if len(ps) == 1 else b"".join([self._special[p] if i % 2 else next(found) for i, p in enumerate(ps)]) for ps in parts
        ]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of all ``words`` (and others)."""
        known, old = self._new, self._old
        missing = [w for w in words if w not in known]
        if old:
            known.update([(w, old[w]) for w in missing if w in old])
            missing = [w for w in missing if w not in old]
        if missing:
            known.update(zip(missing, self._encode_words(missing), strict=True))
        return known
