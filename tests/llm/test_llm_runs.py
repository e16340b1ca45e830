"""Periodic runs against their definition."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmill.llm import periodic_runs, queries


def brute_runs(w):
    """Every maximal stretch of each period, smallest periods only."""
    out = []
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(w[i : i + length - r] == w[i + r : i + length] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    keep = [True] * n
    for s, length, q in runs:
        for i in range(s + q, s + length):
            keep[i] = False
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for w, k in zip(words, keep, strict=True) if k)),
    )


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70) | st.lists(st.integers(0, 1), max_size=40))
def test_runs_are_those_of_the_definition(w):
    a = np.array(w, np.int64)
    assert periodic_runs.runs_of(a) == brute_runs(w)
    assert bool(periodic_runs.may_have_runs(a, np.zeros(len(w), np.int64), 1)[0]) >= bool(brute_runs(w))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_planted_periods(parts):
    w = [x for cycle, times in parts for x in cycle * times]
    assert periodic_runs.runs_of(np.array(w, np.int64)) == brute_runs(w)


def test_block_test_tells_texts_apart():
    texts = [[1] * 6, [1] * 5, list(range(50)) + list(range(50)), [1, 2, 3] * 4, [1, 2, 3] * 3]
    flat, of = np.concatenate(texts), np.repeat(np.arange(5), [len(t) for t in texts])
    got = periodic_runs.may_have_runs(flat, of, 5)
    assert got[0] and got[3] and not got[1] and not got[2]


def test_positions_stay_in_order():
    rng = np.random.default_rng(1)
    numbers = rng.permutation(5000).tolist()
    s = periodic_runs.Positions(numbers[0])
    for i, x in enumerate(numbers[1:], 1):
        seen = sorted(numbers[:i]) if i % 500 == 0 else None
        if seen:
            assert s.around(x) == (max((y for y in seen if y < x), default=-1), min((y for y in seen if y > x), default=-1))
        s.add(x)
    assert list(s) == sorted(numbers) and s.size == 5000


def test_query_is_the_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 20000")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = periodic_runs.digests(periodic_runs.find_runs(docs.withColumn("text", periodic_runs.planted(docs.text, docs.doc_id))))
    assert sorted(map(tuple, got.collect())) == sorted(brute_row(*r) for r in rows)
    whole = queries.QUERIES["op13_periodic_runs"](spark, sf_dir)
    assert whole.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert whole.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert whole.filter("n_runs > 0").count() > 5


@pytest.mark.parametrize("planted", [False, True])
def test_odd_rows(spark, tmp_path, planted):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0] if planted else range(100, 4000)
    texts = [None, "", " \t\n ", "a", "a b " * 9, "x\x0by\x0cz " * 4, "la " * 3000, " ".join(f"w{i}" for i in range(700)) + " " + "u v " * 40, "Ab ab " * 5, "é \x1d " * 7]
    rows = [(i, t) for i, t in zip(ids, texts, strict=False)] + [(None, "q r " * 5), (None, "q r " * 5), (77, "x " * 6), (77, "x " * 6)]
    docs = spark.createDataFrame([(*r, 1, "r") for r in rows], "doc_id long, text string, start long, runs string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((brute_row(*r) for r in rows), key=key)
    empty = periodic_runs.find_runs(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["id", "runs", "collapsed"]
