"""BPE and the token store against the tokenizers library."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkmill.llm import bpe, pieces, queries, token_store
from inkmill.llm.token_store import EliasFano

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ODD = [
    None, "", " ", "\n", "x\n", "\n\nx", "a  b", "a \nb", "\ta", "don't I'll we've'd", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b\n c", "aaaaaaaaaaa aaaaa",
    "日本語テキスト です", "՘x ՘", "💩💩 ok é\u0301", "\x00\x01\x85 x", "a, b. c!) d;;e", "1234 5678,90", "x" * 30000, "word " * 20000, "\u2028 a\u3000b",
]


@pytest.mark.parametrize("cache", [bpe.coder(PATH)[1], token_store._cache(PATH)[0]], ids=["pair index", "library"])
def test_encoders_equal_the_library(cache):
    ids, offsets = cache.encode(pa.array(ODD))
    for text, got in zip(ODD, np.split(ids, offsets[1:-1]), strict=True):
        assert got.tolist() == ids_of(text), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 'st\n\t.,1é日՘😀\u3000<|endoftext>"), max_size=40), max_size=6))
def test_any_texts(texts):
    _, cache = bpe.coder(PATH)
    ids, offsets = cache.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, offsets[1:-1])][: len(texts)] == [ids_of(t) for t in texts]


def test_code_points_that_are_split_by_pattern_are_split_as_the_library_does():
    s = pieces.Splitter(PATH)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        text = f"a{chr(cp)}1{chr(cp)} {chr(cp)}!"
        if pieces._SAFE.fullmatch(text):
            assert s._find(text) == [text[a:b] for _, (a, b) in s._slow(text)], hex(cp)


def test_words_are_forgotten_in_two_steps():
    splitter = pieces.Splitter(PATH)
    calls = []

    def encode(texts):
        calls.extend(texts)
        return [np.array(ids_of(pieces.as_it_stands(t)), "<u4").tobytes() for t in texts]

    cache = pieces.WordCache(splitter, encode, lambda ts: [np.array(ids_of(t), "<u4").tobytes() for t in ts], limit=2)
    for text in ("a b c d", "a b", "e f g", "h i j", "b"):
        ids, _ = cache.encode(pa.array([text, "x " + text]))
        assert ids.tolist() == ids_of(text) + ids_of("x " + text)
    assert calls.count("b") == 2 and calls.count("c") == 1


def test_ids_are_laid_out_without_arrays_of_places():
    cache = pieces.WordCache(pieces.Splitter(PATH), lambda ws: [bytes(40_000)] * len(ws), lambda ts: [b""] * len(ts))
    tracemalloc.start()
    try:
        ids, offsets = cache.encode(pa.array(["x" + " a" * 200]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(ids) == 2_000_000 and offsets.tolist() == [0, 2_000_000]
    assert most < len(ids)  # bytes; two arrays of places took 32 000 000


def test_a_batch_on_its_way_to_the_encoder_is_one_run(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        bpe.encode(documents(spark), PATH)
        assert 0 < int(spark.conf.get(name)) <= bpe.RUN_CHARS <= 1 << 20
    finally:
        spark.conf.set(name, before)


def documents(spark, extra=""):
    rows = [(i, t, f"s{i}") for i, t in enumerate(ODD)] + [(3, ODD[3], "again"), (None, "no id", None), (-5, "below zero", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_round_trip(spark):
    rows = bpe.round_trip(documents(spark), PATH).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        text = {None: "no id", -5: "below zero"}.get(r.doc_id, ODD[r.doc_id or 0])
        ids = ids_of(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_frames(spark):
    docs = documents(spark)
    encoded = bpe.encode(docs, PATH, keep=("doc_id", "ids"))
    assert encoded.columns == ["doc_id", "ids", "n_tokens", "input_ids"]
    texts = {(r.doc_id, r.ids): r.text for r in bpe.decode(encoded, PATH, keep=("doc_id", "ids")).collect()}
    assert texts == {(r.doc_id, r.ids): r.text or "" for r in docs.collect()}
    assert bpe.encode(docs.limit(0), PATH).count() == 0 == bpe.round_trip(docs.limit(0), PATH).count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=300))
def test_elias_fano(values):
    values.sort()
    e = EliasFano.from_bytes(EliasFano.build(np.array(values, np.uint64)).to_bytes())
    assert [e.select(i) for i in range(len(values))] == values
    assert e.select_many(np.arange(len(values))).tolist() == values
    asked = [0, 2**62, *values[:20], *(v + 1 for v in values[:20])]
    assert e.below(np.array(asked, np.uint64)).tolist() == [sum(v < a for v in values) for a in asked]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 4000))
    assert len(EliasFano.build(ends).to_bytes()) < 4000 * 64 / 8 / 3


def test_elias_fano_beside_a_very_long_document():
    ends = np.cumsum([3, 5, 10_000_000, *[4] * 500, 9_000_000, 1]).astype(np.uint64)
    e = EliasFano.build(ends)
    assert e.select_many(np.arange(len(ends))[::-1]).tolist() == ends[::-1].tolist()


@pytest.mark.parametrize("segment", [2, 4096])
def test_store(spark, monkeypatch, tmp_path, segment):
    monkeypatch.setattr(token_store, "SEGMENT_DOCS", segment)
    docs = documents(spark)
    rows = token_store.store_and_read(docs, PATH, parts=3).collect()
    wanted, start = [], 0
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in order:
        ids = [*ids_of(r.text), 0]
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == wanted
    token_store.write_store(docs, PATH, str(tmp_path / "s"), parts=3)
    found = token_store.lookup(spark, str(tmp_path / "s"), [10, 11, -5, 3, 10**6]).collect()
    wanted = [(r.doc_id, [*ids_of(r.text), 0]) for r in order if r.doc_id in (10, 11, -5, 3)]
    assert sorted((r.doc_id, r.input_ids) for r in found) == sorted(wanted)


def test_empty_store(spark):
    assert token_store.store_and_read(documents(spark).limit(0), PATH, parts=2).count() == 0


def test_queries_over_a_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_bpe(spark, sf_dir).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(ids_of(texts[r.doc_id]), "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    rows = queries.op7_token_store(spark, sf_dir).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(texts)
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array([*ids_of(texts[r.doc_id]), 0], "<u4").tobytes())
