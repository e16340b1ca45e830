"""Phrase collocations against their definition and their SQL."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkmill.llm import phrases, queries
from inkmill.llm.common import Scratch

from ..oracle import connect, same


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        for words in pieces(text):
            n["und" if lang is None else lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f["und" if lang is None else lang, tuple(words[i : i + m])] += 1
    c = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    longer = defaultdict(int)
    for (lang, w), a in c.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], a)
    best = defaultdict(list)
    for (lang, w), a in c.items():
        if 100 * longer[lang, w] >= 80 * a:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        best[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in best.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def test_query_equals_its_sql(spark, sf_dir):
    same(queries.QUERIES["op11_phrases"](spark, sf_dir), connect(sf_dir).sql(queries.ORACLE_SQL["op11_phrases"]))


@pytest.mark.parametrize("held,burst", [(1 << 20, 4096), (50, 4)], ids=["held", "spilled and burst"])
def test_phrases_are_those_of_the_definition(spark, sf_dir, held, burst):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 6000").select("lang", "text")
    docs = docs.union(docs.selectExpr("CAST(NULL AS string)", "text").limit(30))
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(5)
    got = phrases.collocations(docs, least=4, top=150, held=held, burst=burst)
    assert sorted(map(tuple, got.collect())) == brute([tuple(r) for r in docs.collect()], 4, 150)


def test_odd_rows(spark):
    rows = [(None, None), ("x", None), ("x", ""), ("x", " .,; "), ("", "A b. a B" * 3), ("n\x00l", "p\x00q \x01r p\x00q \x01r " * 4), ("z", "a\x01 b a\x01 b; a b a b " * 4)]
    rows += [("x", "One two three four five, one two " * 5)] * 3 + [("long", "k l m " * 300000)] + [("é", "É é É é")] * 2
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, rank int")
    got = phrases.collocations(docs, least=2, top=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 5)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_a_common_prefix_spans_ranges(spark):
    rows = [("en", " ".join(f"hot pair w{i} v{i % 7}." for i in range(j, j + 2000))) for j in range(0, 20000, 2000)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    scratch = Scratch(spark, "test")
    everything = phrases.Pairs(np.full(1 << 10, -1, np.int64).view(np.uint64))
    merged = scratch.keep(phrases.windows(docs, everything)).repartitionByRange(8, "key")
    sizes = [r["count"] for r in merged.groupBy(phrases.F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    got = {r.key.replace("\x00", " "): r.c for r in phrases.counts(scratch, docs, 1000).collect()}
    assert got["en hot"] == got["en hot pair"] == 20000 and got["en"] == 80000 and "en hot pair w1" not in got


def test_trie_counts_and_spills_whole_subtrees():
    trie, want = phrases.HatTrie(burst=3), Counter()
    windows = [(i % 3, (i % 5) << 42 | (i % 7) << 21 | (i % 11)) for i in range(3000)]
    for a, s in windows:
        want[a, s] += 1
    trie.add(*map(list, zip(*windows)))
    assert trie.size == len(want) and any(isinstance(t, phrases._Node) for t in trie.root.values())
    got = Counter()
    for most in (len(want) // 2, 0):
        first, rest, n = trie.spill(most)
        assert trie.size <= most and not set(first.tolist()) & set(trie.root)
        got.update({(a, s): c for a, s, c in zip(first.tolist(), rest.tolist(), n.tolist())})
    assert got == want


def test_the_filter_keeps_no_frequent_pair_out(spark):
    rng = np.random.default_rng(2)
    h = (rng.integers(0, 1 << 48, 50000)).astype(np.int64)
    pairs = phrases.Pairs.of(spark.createDataFrame([(int(x),) for x in h[:5000]], "h long"))
    assert pairs.holds(h[:5000].view(np.uint64)).all()
    assert pairs.holds(h[5000:].view(np.uint64)).mean() < 0.05 and len(pairs.words) * 64 >= 16 * 5000
    assert not phrases.Pairs.of(spark.createDataFrame([], "h long")).holds(h.view(np.uint64)).any()


def test_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(phrases, "TOKENS", 16)
    for text in (b"ab cd. ef\tgh " * 60, b"x" * 500 + b" y z" * 100, b"a." * 300, b"", b" " * 400 + b"w"):
        parts = list(phrases._slices(text))
        assert [t for tokens, n in parts for t in tokens[:n]] == phrases._tokens(text)
        assert all(len(t) - n == phrases.LONGEST - 1 for t, n in parts[:-1])


def test_a_task_numbers_a_bounded_number_of_words():
    """Far fewer than fit the bits of a number: the words of a task are kept in memory."""
    reader = phrases._Reader()
    list(reader.add("en", " ".join(f"w{i}" for i in range(300_000))))
    assert reader.full() and phrases.HELD <= 1 << 19
    reader.forget()
    assert not reader.full()
