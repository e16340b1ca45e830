"""Language identification, mixing and the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkmill.llm import langid, mixing, queries
from inkmill.llm.common import Scratch


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    held = [r for r in rows if r.held_out]
    import zlib

    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_have_defined_languages(spark):
    words = {"xx": "lorem ipsum dolor sit amet ", "yy": "der schnelle braune fuchs springt "}
    rows = [(i, words[k] * (1 + i % 5), k, 1, "a") for i in range(40) for k in words] + [(None, "lorem ipsum dolor", "xx", 1, "a"), (90, "lorem", None, 1, "a")]
    rows += [(91, None, "xx", 1, "a"), (92, "", "xx", 1, "a"), (93, "12 ?! \n", "yy", 1, "a"), (94, "fuchs " * 100000, None, 1, "a"), (94, "fuchs", None, 1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, rejected string")
    out = langid.identify(df)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.lang_pred, r.rejected, r.score))
    assert len(got[94]) == 2 and {x[0] for x in got[94]} == {"yy"} and got[90][0][0] == "xx" == got[None][0][0]
    for i in (91, 92, 93):
        assert got[i] == [("und", True, 0.0)]
    kept = langid.keep_known(df)
    assert kept.columns == df.columns
    assert not {91, 92, 93} & {r.doc_id for r in kept.collect()} and kept.filter("doc_id < 40").count() == 80
    assert langid.identify(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_predictions_do_not_see_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    one = {r.doc_id: r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    two = {r.doc_id: r.lang_pred for r in langid.predict(docs.select("doc_id", "text").orderBy(F.desc("doc_id")), model).collect()}
    assert one == two


def test_texts_of_no_learned_language_are_rejected_at_every_length(spark, sf_dir):
    r = random.Random(4)
    russian = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью".split()
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki".split()
    rows = [(f"{k}{n}", " ".join(r.choice(words) for _ in range(n))[:n]) for k, words in (("ru", russian), ("fi", finnish)) for n in (5, 10, 20, 40, 80, 300) for _ in range(50)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = langid.held_out(F.col("doc_id"))
    short = [docs.filter(held).select(F.lit(f"own{n}").alias("k"), F.substring("text", 1, n).alias("text")) for n in (10, 20, 80)]
    everything = spark.createDataFrame(rows, "k string, text string")
    for s in short:
        everything = everything.unionByName(s)
    model = langid.fit(docs, ~held)
    share = {x.k: x.r for x in langid.predict(everything, model).groupBy("k").agg(F.avg(F.col("rejected").cast("int")).alias("r")).collect()}
    assert all(share[f"ru{n}"] >= 0.9 for n in (5, 10, 20, 40, 80, 300)) and share["fi300"] >= 0.9, share
    assert all(share[f"own{n}"] <= 0.05 for n in (10, 20, 80)), share


def test_clusters_are_unit_vectors():
    x = np.eye(6)[np.arange(60) % 6].astype(np.float32)
    c = langid.spherical_kmeans(x, 4)
    assert c.shape == (4, 6) and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert langid.spherical_kmeans(x[:1].repeat(5, 0), 4).shape[0] == 1


SOURCES = {"big": 800, "mid": 200, "small": 40, None: 10}


def corpus(spark):
    rows, i = [], 0
    for s, n in SOURCES.items():
        for _ in range(n):
            rows.append((i, s, "w " * (1 + i % 9), "clash"))
            i += 1
    rows += [(i, "empty", None, "clash"), (i + 1, "empty", "", "clash"), (None, "mid", "no id", "clash"), (5, "big", "w " * 6, "clash")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, _copies string")


def count(text):
    return len((text or "").split())


@pytest.mark.parametrize("target", [{"repetition": 2.0}, {"repetition": 3.0, "budget": 4000.0}, {"entropy": 1.2}])
def test_mixture_meets_its_weights(spark, target):
    df = corpus(spark)
    tokens, rows = Counter(), df.collect()
    for r in rows:
        tokens[r.source] += count(r.text)
    total = sum(tokens.values())
    drawn, epochs = Counter(), defaultdict(Counter)
    for r in mixing.mix(df, **target).collect():
        drawn[r.source] += r.tokens
        epochs[r.source][r.epoch] += r.tokens
    p = {s: n / total for s, n in tokens.items() if n}

    def weights(x):
        z = sum(q**x for q in p.values())
        return {s: q**x / z for s, q in p.items()}

    def drawn_at(x, budget):
        w = weights(x)
        b = budget or max(tokens[s] / w[s] for s in w)
        return {s: w[s] * b / tokens[s] for s in w}

    low, high = 0.0, 1.0  # plain bisection
    for _ in range(60):
        x = (low + high) / 2
        w = weights(x)
        if "entropy" in target:
            ok = -sum(v * math.log(v) for v in w.values()) >= target["entropy"]
            low, high = (x, high) if ok else (low, x)
        else:
            ok = max(drawn_at(x, target.get("budget")).values()) <= target["repetition"]
            low, high = (low, x) if ok else (x, high)
    wanted = drawn_at(high, target.get("budget"))
    for s, e in wanted.items():
        assert drawn[s] <= e * tokens[s] + 1
        assert drawn[s] >= e * tokens[s] - 20  # one document, or rows that share a place
        assert all(epochs[s][k] == tokens[s] for k in range(int(e - 1e-4)))
    copies = Counter(r.doc_id for r in mixing.mix(df, **target).collect() if r.source == "empty")
    assert set(copies.values()) == {1} and len(copies) == 2


def test_exponent_ends(spark):
    totals = spark.createDataFrame([("a", 100), ("b", 100)], "source string, tokens long")
    assert mixing.find_exponent(totals, repetition=1.0) == 0.0
    assert mixing.find_exponent(totals, entropy=math.log(2)) == 1.0
    skewed = spark.createDataFrame([("a", 1000), ("b", 1)], "source string, tokens long")
    assert mixing.find_exponent(skewed, entropy=5.0) == 0.0  # no exponent reaches it
    with pytest.raises(ValueError):
        mixing.find_exponent(totals)


def test_last_epoch_is_a_prefix_of_the_permutation(spark):
    df = corpus(spark)
    rows = [r for r in mixing.mix(df, repetition=3.0).collect() if r.source == "mid"]
    last = max(r.epoch for r in rows)
    assert last >= 1
    every = {(r.block_order, r.doc_order) for r in mixing.mix(df, repetition=3.0).collect() if r.source == "mid" and r.epoch == 0}
    assert len(every) == 201
    orders = [[(r.block_order, r.doc_order) for r in rows if r.epoch == e] for e in (0, 1)]
    assert sorted(orders[0]) != sorted(orders[1])
    # the documents of the last epoch come before all others in that epoch's order
    docs = spark.createDataFrame([(r.doc_id,) for r in rows if r.epoch == 0], "doc_id long")
    e = F.lit(last)
    place = docs.select("doc_id", mixing._block_order(mixing._block(F.col("doc_id")), e).alias("b"), mixing._doc_order(F.col("doc_id"), e).alias("d")).collect()
    taken = {r.doc_id for r in rows if r.epoch == last}
    ordered = [p.doc_id in taken for p in sorted(place, key=lambda p: (p.b, p.d))]
    assert ordered == sorted(ordered, reverse=True)


def test_mixing_query(spark, sf_dir):
    """The registered query on its whole table, held against plain bisection and plain sorting."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokens = Counter()
    for r in docs.values():
        tokens[r.source] += count(r.text)
    rows = queries.op8_mixing(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.source == docs[r.doc_id].source and r.tokens == count(docs[r.doc_id].text) for r in rows)
    total, low, high = sum(tokens.values()), 0.0, 1.0
    for _ in range(60):
        x = (low + high) / 2
        powers = {s: (n / total) ** x for s, n in tokens.items()}
        least = max(tokens[s] / p for s, p in powers.items())
        low, high = (low, x) if max(powers[s] * least / tokens[s] for s in powers) <= 4 else (x, high)
    drawn, longest = Counter(), max(count(r.text) for r in docs.values())
    for r in rows:
        drawn[r.source] += r.tokens
    for s, p in powers.items():
        assert p * least - longest <= drawn[s] <= p * least + 1
    order = F.struct(mixing._block_order(mixing._block(F.col("doc_id")), F.col("e")), mixing._doc_order(F.col("doc_id"), F.col("e")))
    ids = spark.createDataFrame([(i,) for i in docs], "doc_id long").crossJoin(spark.range(5).withColumnRenamed("id", "e"))
    place = {(r.doc_id, r.e): tuple(r.o) for r in ids.select("doc_id", "e", order.alias("o")).collect()}
    for s in tokens:
        own = [i for i, r in docs.items() if r.source == s]
        for e in range(5):
            taken = {r.doc_id for r in rows if r.source == s and r.epoch == e}
            assert taken == set(sorted(own, key=lambda i: place[i, e])[: len(taken)])


def test_empty_mixture(spark):
    df = corpus(spark).limit(0)
    assert mixing.mix(df, repetition=2.0).count() == 0 == mixing.repeat(df, repetition=2.0).count()
    assert mixing.repeat(corpus(spark), repetition=2.0).columns == df.columns


def plain_prediction(model, text):
    """Best language and cosine of one text, gram by gram."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + re.sub(" +", " ", letters) + " "  # each end has one more space
    grams = Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    vector = Counter()
    for g, n in grams.items():
        h = 0
        for i, c in enumerate(g):
            if i == 0:
                h = ord(c) * 0x9E3779B1
            elif i == 1:
                h = (h % 2**32 ^ 0x5BD1E995) * 0x85EBCA6B + ord(c) * 0x9E3779B1
            else:
                h = (h % 2**32 ^ 0x27D4EB2F) * 0xC2B2AE35 + ord(c) * 0x9E3779B1
        h %= 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        vector[h >> 32 - model.bits] += n
    norm = math.sqrt(sum((n * float(model.idf[b])) ** 2 for b, n in vector.items()))
    sims = [sum(n * float(model.weights[b, j]) for b, n in vector.items()) / norm for j in range(model.weights.shape[1])]
    best = max(range(len(sims)), key=sims.__getitem__)
    return model.languages[model.owner[best]], sims[best]


def test_predictions_are_those_of_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))
    model = langid.fit(docs, known)
    lengths = np.linalg.norm(model.weights / model.idf[:, None], axis=0)
    assert np.allclose(lengths, 1, atol=1e-4) and len(model.owner) <= langid.CLUSTERS * len(model.languages)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.predict(docs.select("doc_id", "text"), model).collect():
        if any(c.isalpha() for c in texts[r.doc_id] or ""):
            lang, sim = plain_prediction(model, texts[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - min(max(sim, 0), 1)) < 1e-4


def test_one_id_with_all_rows_of_a_language(spark):
    """A language whose rows share an id is learned, from a bounded number of them."""
    r = random.Random(4)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["kyrie", "zwox", "quux", "jyx"]}
    text = lambda lang: " ".join(r.choice(words[lang]) for _ in range(20))
    rows = [(5, text("aa"), "aa") for _ in range(900)] + [(i, text("bb"), "bb") for i in range(10, 60)] + [(7, "once", f"dirt{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True), per_language=100, most_languages=2)
    assert model.languages == ["aa", "bb"]
    got = langid.predict(spark.createDataFrame([(1, text("aa")), (2, text("bb"))], "doc_id long, text string"), model)
    assert {x.doc_id: x.lang_pred for x in got.collect()} == {1: "aa", 2: "bb"}


def test_centroids_and_floors_come_from_all_labelled_texts(spark):
    """Far more texts than centroids start on, against plain sums and plain percentiles."""
    r = random.Random(5)
    words = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(300)] for k, a in (("aa", "abcdefgh"), ("bb", "ghijklmnop"))}
    texts = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(30, 50))), k) for i in range(900) for k in words]
    model = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(5), F.lit(True), per_language=10, clusters=1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(langid.gram_counts([t for _, t, _ in texts]).astype(float) * model.idf)
    own = np.array([model.languages.index(k) for *_, k in texts])
    sums = unit(np.array([x[own == i].sum(0) for i in range(2)]))
    assert np.allclose(model.weights.T / model.idf, sums[model.owner], atol=1e-5)
    length = np.log2(langid.gram_counts([t for _, t, _ in texts]).sum(1)).astype(int)
    sims, last = (x * sums[own]).sum(1), 0.0
    for b in sorted(set(length.tolist())):
        of = np.sort(sims[length == b])
        if len(of) >= langid.ENOUGH:
            assert model.floors[b] == pytest.approx(langid.REJECT_BELOW * of[-(-len(of) // 100) - 1], abs=2e-4) or model.floors[b] == model.floors[b - 1]
            last = b
    assert last and model.floors[last] > 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Whole runs over an empty table, and over nulls and columns whose names operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, component_id string, whole int, tokens string"
    good = "der die das und nicht ein ist mit von auf " * 3
    rows = [(i, good + f"wort{i} satz{i * 7} " * 4, "de", "s", 1, 1, "c", 2, "t") for i in range(30)]
    rows += [(None, None, None, None, None, None, None, None, None), (40, "", "de", None, 0, 1, "c", 2, "t"), (1, rows[1][1], "de", "s", 1, 1, "c", 2, "t"), (41, "123", "de", "s", 3, 1, "c", 2, "t")]
    for name, some in (("empty", []), ("odd", rows)):
        (tmp_path / name).mkdir()
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert sorted({r.doc_id for r in out}) == (list(range(30)) if some else [])


def test_pipeline_stages(spark, sf_dir):
    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = scratch.keep(stage(spark, before, sf_dir))
        before = seen[name]
    n = docs.count()
    assert seen["language"].columns == docs.columns and seen["language"].count() >= 0.98 * n
    lone = seen["near_duplicates"]
    assert lone.columns == docs.columns
    assert lone.select("text").distinct().count() == lone.count() == lone.select("doc_id").distinct().count()
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    kept = {r.doc_id: shingles(r.text) for r in lone.collect()}
    everything = {r.doc_id: shingles(r.text) for r in seen["language"].collect()}
    like = lambda a, b: len(a & b) / len(a | b)
    for i in everything.keys() - kept.keys():
        assert max(like(everything[i], s) for j, s in everything.items() if j != i) >= 0.6
    ids = sorted(kept)
    assert not [(a, b) for x, a in enumerate(ids) for b in ids[:x] if like(kept[a], kept[b]) >= 0.9]
    mixed = Counter(r.doc_id for r in seen["mixture"].select("doc_id").collect())
    assert set(mixed) == set(kept) and max(mixed.values()) <= 2
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokens = seen["tokens"].collect()
    assert Counter(r.doc_id for r in tokens) == mixed
    for r in tokens[:60]:
        assert r.input_ids == tok.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, sf_dir).count() == len(tokens)
