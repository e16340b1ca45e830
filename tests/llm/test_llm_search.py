"""SimHash groups and the two searches against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkmill.llm import binary_search, near_copies, queries, simhash, vector_tree
from inkmill.llm.common import Scratch, connected_components

from ..oracle import connect, same


def groups_of(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_groups(rows, texts):
    ids = [r.doc_id for r in rows]
    fps = [int(r.fingerprint, 16) for r in rows]
    for r in rows:
        assert r.fingerprint == f"{fingerprint(texts[r.doc_id]):016x}"
    roots = groups_of(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    for i, r in enumerate(rows):
        assert r.component_id == min(ids[j] for j in range(len(rows)) if roots[j] == roots[i])


def test_groups_of_odd_texts(spark):
    r = random.Random(3)
    base = [r.choice(["alpha", "beta", "gamma", "delta", "Épsilon"]) + str(r.randint(0, 99)) for _ in range(400)]
    texts = {0: None, 1: "", 2: " \t\n\x0b\x0c\r", 3: "one", 4: "ONE", 5: "one two", 6: "É é", 7: "é É", 8: "w " * 50000, 9: "a\u00a0b c d", 10: "a\x1cb c d"}
    for i in range(20, 160):  # near copies of one text, and a chain of them
        words = list(base)
        for _ in range(i % 7):
            words[r.randrange(400)] = f"edit{r.randint(0, 9)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in texts.items()] + [(20, texts[20], 5, "z")], "doc_id long, text string, keys int, fp string")
    rows = simhash.contract_groups(df).collect()
    assert len(rows) == len(texts) + 1
    check_groups(rows, texts)
    assert simhash.contract_groups(df.limit(0)).count() == 0


def test_simhash_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_groups(queries.op3_simhash(spark, sf_dir).collect(), texts)


@pytest.mark.parametrize("distance", [1, 3])
def test_crowded_fingerprints_lose_no_link(spark, distance):
    """Balls of fingerprints around a few centers, whose keys are shared by nearly all of them."""
    r = random.Random(distance)
    centers = [r.getrandbits(64) for _ in range(3)]
    centers.append(centers[0] ^ 0b1111111)  # a second ball beside the first
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centers for _ in range(150)})
    tables = simhash.block_tables(64, distance, 2)
    bits = [np.array([f >> b & 1 for b in range(64)], np.uint8) for f in fps]
    rows = [(i, [f - (1 << 64) if f >> 63 else f], [int(b[t] @ (1 << np.arange(len(t)))) for t in tables]) for i, (f, b) in enumerate(zip(fps, bits, strict=True))]
    df = spark.createDataFrame(rows, "id long, fp array<long>, keys array<long>")
    got = {x.id: x.component_id for x in simhash.near_groups(df, 1, distance).collect()}
    roots = groups_of(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= distance)
    assert got == dict(enumerate(roots))


def test_bit_counts():
    rows = np.random.default_rng(0).integers(0, 2**63, (1000, 3)).astype(np.uint64)
    wanted = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(0)
    assert (simhash.bit_counts(rows) == wanted).all()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in connected_components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_keep_one(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randint(0, 500)}" for _ in range(300)) for _ in range(30)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(100 + i, t, i) for i, t in enumerate(texts[:10])] + [(0, texts[0], 9), (200, None, 0), (201, "", 0), (None, texts[3], 7)]
    for i in range(10, 15):  # three words of three hundred changed: similarity about 0.9
        words = texts[i].split()
        for j in (50, 51, 200):
            words[j] = "changed"
        rows.append((300 + i, " ".join(words), 1))
    spark.createDataFrame(rows, "doc_id long, text string, _row long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == [*range(30), 200]


def test_tree_finds_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:1100] = x[100]  # a third of all rows is one vector
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(5000, None, ""), (5020, [0.0] * 16, ""), (5040, [float("nan")] * 16, ""), (5060, [None] * 16, ""), (5080, [1.0] * 3, ""), (None, [1.0] * 16, ""), (0, rows[0][1], "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    got = {}
    for r in vector_tree.search(df, query_every=20, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == list(range(0, 3000, 20))
    exact = x.astype(float)
    hit = 0
    for q, rs in got.items():
        assert [r["rank"] for r in rs] == list(range(1, 21))
        score = exact @ exact[q]
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -np.round(score, 9)))[:20]
        hit += len({r.vec_id for r in rs} & set(best.tolist()))
    assert hit / (20 * len(got)) >= 0.9


def test_tree_of_two_levels_visits_few_leaves(spark):
    """60 clusters, over 50 leaves on two levels or more, hot and repeated ids; recall by brute force."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(60, 24)) * 3
    x = (centers[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 24)) * 0.5).astype(np.float32)
    ids = np.arange(6000)
    ids[5000:5400] = 7  # one id with 400 vectors
    ids[5400:5403] = 100  # a query with four
    df = spark.createDataFrame([(int(i), v.tolist(), 1.0, 2) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score double, leaf int")
    report = {}
    got = {}
    for r in vector_tree.search(df, query_every=100, k=20, leaf_rows=80, report=report).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert report["leaves"] >= 50 > vector_tree.BRANCH and report["met"] < report["leaves"] / 2
    x, hit = x.astype(float), 0
    for q, near in got.items():
        assert near == sorted(near) and len({i for _, i in near}) == 20 and q not in {i for _, i in near}
        scores = {}
        for v in x[ids == q]:
            for i, s in zip(ids.tolist(), x @ v):
                if i != q:
                    scores[i] = max(scores.get(i, -np.inf), s)
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        hit += len(set(best) & {i for _, i in near})
        assert all(abs(scores[i] + s) < 1e-6 for s, i in near)
    assert len(got) == 60 - 5 and hit / (20 * len(got)) >= 0.95, hit / (20 * len(got))


def test_few_vectors_are_all_returned(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(0, 6)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vector_tree.search(df, k=20).orderBy("rank").collect()] == [5, 4, 3, 2, 1]
    assert vector_tree.search(df.limit(0)).count() == 0 == vector_tree.search(df.limit(1)).count()


def test_tree_query_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in queries.op4_vector_tree(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("spread", [64, 6])
def test_binary_search(spark, spread):
    r = random.Random(spread)
    center = r.getrandbits(63)
    codes = {i: center ^ sum(1 << b for b in r.sample(range(63), r.randint(0, min(spread, 40)))) for i in range(600)}
    codes |= {i: center for i in range(600, 900)}
    rows = [(i, c, "x") for i, c in codes.items()] + [(7, codes[7], "again"), (None, 1, ""), (950, None, "")]
    df = spark.createDataFrame(rows, "id long, code long, n string")
    got = {}
    for x in binary_search.search(df, F.col("id") % 50 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.id, x.distance))
    assert sorted(got) == list(range(0, 900, 50))
    for q, hits in got.items():
        wanted = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:10]
        assert hits == [(i, d) for d, i in wanted]


def test_binary_search_of_few_or_none(spark):
    df = spark.createDataFrame([(0, 0), (1, -1), (2, 1)], "id long, code long")
    assert [(r.id, r.distance) for r in binary_search.search(df, F.col("id") == 0).orderBy("rank").collect()] == [(2, 1), (1, 64)]
    assert binary_search.search(df.limit(0), F.lit(True)).count() == 0
    odd = spark.createDataFrame([([1.0, -1.0, 0.0],), (None,), ([float("nan")],), ([],), ([None],)], "v array<float>")
    assert [r.c for r in odd.select(binary_search.sign_code(F.col("v")).alias("c")).collect()] == [[1], None, None, None, None]


def test_codes_of_any_length(spark):
    """Vectors of 1 to 200 components: all are searched, bits that a shorter one lacks are zero."""
    rng = np.random.default_rng(12)
    vectors = [(i, rng.normal(size=int(n)).tolist()) for i, n in enumerate(rng.choice([1, 64, 65, 128, 200], 400))]
    for i in range(0, 400, 4):  # near copies, so that not all are far from each other
        vectors.append((1000 + i, [-x if rng.random() < 0.03 else x for x in vectors[i][1]]))
    df = spark.createDataFrame(vectors, "id long, v array<double>")
    codes = df.select("id", binary_search.sign_code(F.col("v")).alias("code"), F.lit("x").alias("qcode"))
    got = {}
    for x in binary_search.search(codes, F.col("id") % 50 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.distance, x.id))
    bits = {i: sum(1 << j for j, x in enumerate(v) if x > 0) for i, v in vectors}
    assert sorted(got) == [i for i in sorted(bits) if i % 50 == 0]
    for q, near in got.items():
        assert near == sorted(((bits[q] ^ b).bit_count(), i) for i, b in bits.items() if i != q)[:10]


def test_segments_are_narrow_at_any_size():
    for words in (1, 3):
        for n in (1, 500, 10**6, 2**32, 2**40):
            cut = binary_search._segments(words, n)
            assert max(w for _, _, w in cut) <= 32 if n == 1 else max(w for _, _, w in cut) <= 22
            assert sum(w for _, _, w in cut) == 64 * words


def test_binary_search_query(spark, sf_dir):
    same(queries.op6_binary_search(spark, sf_dir), connect(sf_dir).sql(queries.ORACLE_SQL["op6_binary_search"]))


def passages(seed, n, jaccards):
    """Random texts and, of each, one with a passage added at its end for each five-word similarity asked for."""
    r = random.Random(seed)
    text = lambda k: [f"w{r.getrandbits(40):x}" for _ in range(k)]
    rows = []
    for i in range(n):
        base = text(404)  # 400 runs of five words
        rows.append((i, " ".join(base), None))
        for k, j in enumerate(jaccards):
            total = int(400 / j) if j >= 0.8 else round(400 / j)  # all 400 runs stay, out of ``total``
            rows.append((1000 * (k + 1) + i, " ".join(base + text(total - 400)), j))
    return rows


def test_bitmaps_never_hide_a_pair():
    rng = np.random.default_rng(3)
    for n in (5, 500, 1020, 1030, 2040, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: int(0.9 * len(a))], rng.integers(0, 2**63, int(0.12 * n) + 1).astype(np.uint64))))
        x, y = near_copies.parity_bitmap(a), near_copies.parity_bitmap(b)
        m = min(len(x), len(y))
        apart = np.bitwise_count((near_copies.folded(x, m) ^ near_copies.folded(y, m)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b)) and len(x) * 64 >= len(a)
        assert np.array_equal(near_copies.folded(x), near_copies.folded(near_copies.folded(x, m)))


def test_long_texts_around_the_threshold(spark, tmp_path):
    """Bitmaps of different lengths meet: 1000 to 1300 runs of five words, on both sides of 1024."""
    r = random.Random(8)
    text = lambda n: [f"w{r.getrandbits(40):x}" for _ in range(n)]
    rows, gone = [], set()
    for i in range(12):
        base = text(1010)
        rows.append((i, " ".join(base)))
        for k, more in enumerate((5, 100, 240, 270)):  # 1006 runs stay, so 251 more are the most
            rows.append((100 * (k + 1) + i, " ".join(base + text(more))))
            if more <= 251:
                gone.add(rows[-1][0])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    sets = {i: near_copies.shingle_set(t, 5) for i, t in rows}
    ids = sorted(sets)
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    roots = groups_of(len(ids), lambda x, y: like(sets[ids[x]], sets[ids[y]]))
    kept = sorted(x.doc_id for x in simhash.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert kept == [i for x, i in enumerate(ids) if roots[x] == x] and gone.isdisjoint(kept)


def test_keep_one_of_hardly_anything(spark):
    schema = "doc_id long, text string, _metadata string, _row string, digest int"
    assert simhash.keep_one(spark.createDataFrame([], schema)).columns == ["doc_id", "text", "_metadata", "_row", "digest"]
    rows = [(None, "a b", "m", "r", 1), (None, "a b", "m", "r", 1), (3, None, None, None, None), (2, " ", None, None, 2), (7, "A  B", "x", "y", 3)]
    kept = simhash.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r["_row"]) for r in kept) == [(2, None), (7, "y")]


def test_passage_sized_edits_from_the_threshold_up(spark, tmp_path):
    rows = passages(11, 60, [0.8, 0.81, 0.85, 0.95])
    spark.createDataFrame(rows, "doc_id long, text string, j double").write.parquet(str(tmp_path / "d"))
    kept = sorted(x.doc_id for x in simhash.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert kept == list(range(60))


def test_near_duplicates_are_those_of_brute_force(spark, sf_dir):
    """Every pair from 0.8 up is one group, and nothing else is: also on the given texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    sets = [{tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))} for r in rows]
    roots = groups_of(len(rows), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == [r.doc_id for i, r in enumerate(rows) if roots[i] == i]


def test_a_passage_that_all_texts_share_joins_none(spark, tmp_path):
    r = random.Random(2)
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, common + " " + " ".join(f"w{r.getrandbits(40):x}" for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, t + " more") for i, t in rows[:50]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert sorted(x.doc_id for x in simhash.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect()) == list(range(300))


def test_no_text_is_dropped_below_the_threshold(spark, tmp_path):
    rows = passages(12, 60, [0.79, 0.75, 0.7])
    spark.createDataFrame(rows, "doc_id long, text string, j double").write.parquet(str(tmp_path / "d"))
    kept = sorted(x.doc_id for x in simhash.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert kept == sorted(i for i, _, _ in rows)


def test_ids_with_several_codes_take_one_place_each(spark):
    r = random.Random(6)
    rows = [(i, r.getrandbits(62)) for i in range(60)]
    for i in range(1, 4):  # ids whose many codes all lie beside the query's own
        rows += [(i, rows[0][1] ^ (1 << a) ^ (1 << b)) for a in range(8) for b in range(a)]
    rows += [(0, rows[0][1] ^ (1 << a)) for a in range(20)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = [(x.query_id, x.rank, x.id, x.distance) for x in binary_search.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    wanted = []
    for q in (0, 20, 40):
        best = {}
        for a in [c for i, c in rows if i == q]:
            for i, c in rows:
                if i != q:
                    best[i] = min(best.get(i, 64), (a ^ c).bit_count())
        wanted += [(q, k + 1, i, d) for k, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:10])]
    assert got == wanted


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_every_given_table_has_a_tree(spark, sf_dir, sf):
    report = {}
    vector_tree.search(spark.read.parquet(f"{sf_dir.replace('0.001', sf)}/embeddings.parquet"), report=report)
    print(sf, report)
    assert report["leaves"] >= 14


@pytest.mark.parametrize("copies", [400, 800])
def test_a_pair_of_a_crowd_comes_out_once(spark, monkeypatch, copies):
    """Copies of one text with so many words changed that each pair is about as near as the threshold."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = {}
    for i in range(copies):
        words = list(base)
        for _ in range(rng.randint(3, 5)):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    met = []
    meetings = near_copies._meetings

    def seen(*args):
        out = meetings(*args)
        met.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(near_copies, "_meetings", seen)
    got = {r.id: r.component_id for r in near_copies.groups(spark.createDataFrame(list(texts.items()), "id long, text string").repartition(8), "id").collect()}
    rows, pairs = met[0]
    print(f"{copies} copies: {rows} rows for {pairs} pairs")
    assert 0 < rows <= 1.5 * pairs
    sets = {i: set(near_copies.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a in texts:
        for b in range(a + 1, copies):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in texts}


def test_near_copies_are_found_by_fingerprints_first(spark, tmp_path, monkeypatch):
    """Groups of near copies come from fingerprints within 3 bits, checked by the sets; the rest of them follows."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(12):
        base = [r.choice(words) for _ in range(400)]
        rows.append((3 * i, " ".join(base)))
        rows.append((3 * i + 1, " ".join([*base, "end"])))  # hardly a bit of the fingerprint changes
        rows.append((3 * i + 2, " ".join([*base[:360], *(r.choice(words) for _ in range(36))])))  # about 0.83
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found, links = near_copies.simhashed, []

    def seen(*args):
        out = found(*args)
        links.extend(out.collect())
        return out

    monkeypatch.setattr(near_copies, "simhashed", seen)
    kept = sorted(x.doc_id for x in simhash.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert kept == [3 * i for i in range(12)]
    prints = [simhash.pack(simhash.fingerprint_bits(near_copies.shingle_set(t, 5))).view(np.uint64) for _, t in rows]
    close = sum(np.bitwise_count(prints[3 * i] ^ prints[3 * i + 1])[0] <= near_copies.DISTANCE for i in range(12))
    assert len(links) >= close >= 6
