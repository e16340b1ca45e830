"""Language identification by nearest centroid.

A text becomes the TF-IDF vector of its letter 1- to 3-grams (hashed to a fixed number of
buckets, over the whole text). Each language has several centroids, found by spherical k-means
over vectors of labelled texts. A text takes the language of the most similar centroid by cosine.
It is rejected if it is further from every centroid than labelled texts of like length are from
their own.

Document frequencies, centroids and rejection distances come from all labelled texts (of the
``most_languages`` most frequent labels). Only the places where centroids start are found on at most
``per_language`` rows of each language, chosen by a hash of the row (so an id with many rows is no
different); passes over all labelled texts then move them to the means of theirs. Rejection distances
are counted over all of them by length, and over excerpts of all where hardly any has a length.

Defined cases: null texts, empty texts and texts without a letter get ``und``, score 0, and are
rejected; rows with a null label or text are not learned from, nor are those with a null id; equal
similarities go to the first language in order; repeated rows get equal results; with nothing to
learn from every text gets ``und``; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, release, set_aside, small_batches

BITS = 14
#: Labelled texts of each language on which centroids start, centroids of each, and passes over all labelled texts.
PER_LANGUAGE, CLUSTERS, ROUNDS = 1000, 4, 2
#: Buckets of a piece of a vector, by which vectors of tasks are added up.
PIECE = 1024
#: Labels that are learned, the most frequent first: the model has ``CLUSTERS`` vectors for each.
MOST_LANGUAGES = 200
#: A text is rejected below this part of the similarity that 1 of 100 labelled texts of its length falls below.
REJECT_BELOW = 0.6
#: Texts a length needs for its floor to do without excerpts, and steps in which similarities are counted.
ENOUGH, STEPS = 20, 10_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_buckets(text: str, bits: int = BITS) -> np.ndarray:
    """The bucket of every 1-, 2- and 3-gram of a text's letters; runs of other characters count as
    one space. Empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.where(letter, points, np.uint32(32))
    new = np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))
    c = np.concatenate(([np.uint32(32)], c[new], [np.uint32(32)])).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + one[2:]
    h = np.concatenate((one[c != 32], two, three))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def gram_counts(texts: list[str | None], bits: int = BITS) -> np.ndarray:
    out = np.zeros((len(texts), 1 << bits), np.float32)
    for i, t in enumerate(texts):
        buckets = gram_buckets(t or "", bits)
        if len(buckets):
            out[i] = np.bincount(buckets, minlength=1 << bits)
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` unit centroids of unit rows; starts are spread by farthest-first choice."""
    centers = x[:1]
    while len(centers) < min(k, len(x)):
        nearest = (x @ centers.T).max(1)
        if nearest.min() > 1 - 1e-6:
            break
        centers = np.concatenate((centers, x[[nearest.argmin()]]))
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centers)
        if np.allclose(moved, centers, atol=1e-6):
            break
        centers = moved
    return centers.astype(np.float32)


@dataclass
class LanguageModel:
    """``weights``: idf times centroid, one column each; ``floors``: least similarity by log2 of the number of grams."""

    bits: int
    languages: list[str]
    owner: np.ndarray
    idf: np.ndarray
    weights: np.ndarray
    floors: np.ndarray


def _row_hash(text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", text, F.monotonically_increasing_id())


def fit(
    docs: DataFrame, learn: Column, label: str = "lang", text: str = "text", bits: int = BITS, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS,
    most_languages: int = MOST_LANGUAGES,
) -> LanguageModel:
    """A model of the rows where ``learn`` holds. Reaching the driver: one number for each bucket,
    ``clusters`` vectors a language and two similarities for each length."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "langid")
    size = 1 << bits
    known = docs.filter(learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select("doc_id", label, text)

    def frequencies(batches):
        seen, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for t in batch.column(text).to_pylist():
                buckets = gram_buckets(t, bits)
                n += 1
                seen[np.flatnonzero(np.bincount(buckets, minlength=size))] += 1
            release()
        if n:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], names=["b", "n"])

    found = known.select(text).mapInArrow(frequencies, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size)
    n = 0
    for r in found:
        if r["b"] < 0:
            n = r["n"]
        else:
            df[r["b"]] = r["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    # texts without a letter have no vector
    known = known.filter(F.col(text).rlike(r"\p{L}"))
    labels = known.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(most_languages)
    counts = {r[label]: r["n"] for r in labels.collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel(bits, [], np.zeros(0, int), idf, np.zeros((size, 0), np.float32), np.zeros(64))
    known = known.filter(F.col(label).isin(languages))
    # somewhat more than wanted by a hash of the row, so that the exact limit works on few rows
    share = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * per_language / v)))])
    some = known.select(F.col(label).alias("lang"), F.col(text).alias("text"), _row_hash(text, 0).alias("h")).filter(
        F.pmod(F.col("h"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = scratch.keep(some.withColumn("place", place).filter(F.col("place") <= per_language).drop("place"), "sample")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "text"])
        x = gram_counts(pdf["text"].tolist(), bits)
        grams = x.sum(1)
        x = x[grams > 0] * idf
        if not len(x):
            return pd.DataFrame({"lang": [], "vector": []})
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centers = spherical_kmeans(x, clusters)
        lang = pdf["lang"].iloc[0]
        release()
        return pd.DataFrame({"lang": lang, "vector": list(centers)})

    rows = sample.groupBy("lang").applyInPandas(starts, "lang string, vector array<float>").collect()
    vectors = sorted(((r["lang"], tuple(r["vector"])) for r in rows))
    owner = np.array([languages.index(v[0]) for v in vectors], int)
    centers = np.array([v[1] for v in vectors], np.float32).reshape(-1, size)
    scratch.drop(sample)
    for _ in range(ROUNDS):
        centers = moved(known, LanguageModel(bits, languages, owner, idf, np.ascontiguousarray((centers * idf).T), np.zeros(64)), centers, label, text)
    model = LanguageModel(bits, languages, owner, idf, np.ascontiguousarray((centers * idf).T), np.zeros(64))
    model.floors = length_floors(known, model, label, text)
    return model


def moved(known: DataFrame, model: LanguageModel, centers: np.ndarray, label: str, text: str, batch_rows: int = 64) -> np.ndarray:
    """The centroids, each at the mean of the texts of its language that are nearest to it. All texts
    count; a task adds up its own, and their sums are added by pieces of vectors."""
    size = 1 << model.bits
    piece = min(PIECE, size)
    shared = known.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        number = {x: i for i, x in enumerate(m.languages)}
        sums = np.zeros((len(m.owner), size))
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                x = gram_counts(batch.column(1).to_pylist(), m.bits)
                own = np.array([number[k] for k in batch.column(0).to_pylist()], int)
                some = (x.sum(1) > 0) & np.isin(own, m.owner)
                x, own = x[some], own[some]
                if len(x):
                    sims = np.where(m.owner == own[:, None], x @ m.weights, -np.inf)
                    x *= m.idf
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    nearest = np.zeros((len(m.owner), len(x)), np.float32)
                    nearest[sims.argmax(1), np.arange(len(x))] = 1
                    sums += nearest @ x
            release()
        for i in np.flatnonzero(sums.any(1)).tolist():
            at = np.arange(0, size, piece)
            columns = [pa.array(np.full(len(at), i, np.int32)), pa.array((at // piece).astype(np.int32)), pa.array(list(sums[i].reshape(-1, piece)))]
            yield pa.RecordBatch.from_arrays(columns, names=["c", "p", "v"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": pdf["c"].iloc[:1], "p": pdf["p"].iloc[:1], "v": [sum(pdf["v"])]})

    schema = "c int, p int, v array<double>"
    total = np.zeros(centers.shape)
    for r in known.select(F.col(label).cast("string"), text).mapInArrow(run, schema).groupBy("c", "p").applyInPandas(added, schema).collect():
        total[r["c"], r["p"] * piece : (r["p"] + 1) * piece] = r["v"]
    norms = np.linalg.norm(total, axis=1, keepdims=True)
    return np.where(norms > 0, total / np.maximum(norms, 1e-12), centers).astype(np.float32)


def excerpts(text: str, at: int) -> list[str]:
    """Pieces of a text from its word number ``at`` (counted on from the first again), with about
    4, 8, 16 ... 2048 grams, as far as the text reaches."""
    starts = [w.start() for w in re.finditer(r"\S+", text)]
    start = starts[at % len(starts)] if starts else 0
    return [text[start : start + n] for n in (2**b // 2 for b in range(1, 12)) if start + n <= len(text)]


def length_floors(known: DataFrame, model: LanguageModel, label: str, text: str) -> np.ndarray:
    """The least similarity by log2 of the number of grams, that 1 of 100 labelled texts falls below;
    of excerpts of all of them where a length has few texts. No shorter length has a higher one.

    Similarities are counted in ``STEPS`` steps, so the driver gets a bounded number of counts.
    """
    shared = known.sparkSession.sparkContext.broadcast(model)
    rows = known.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 20)).alias("at"))

    def counted(cut: bool, told: frozenset) -> dict[int, tuple[int, float]]:
        """(texts, similarity that 1 of 100 falls below) of each length that is not ``told``."""

        def run(batches):
            m = shared.value
            own = {x: np.ascontiguousarray(m.weights[:, m.owner == i]) for i, x in enumerate(m.languages)}
            square = m.idf**2
            seen = np.zeros(64 * (STEPS + 1), np.int64)
            for batch in batches:
                for lang, t, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    for one in excerpts(t, at) if cut else (t,):
                        buckets = gram_buckets(one, m.bits)
                        b = len(buckets).bit_length() - 1
                        if b < 0 or b in told or not own[lang].shape[1]:
                            continue
                        u, c = np.unique(buckets, return_counts=True)
                        c = c.astype(np.float32)
                        sim = (c @ own[lang][u]).max() / np.sqrt((c * c) @ square[u])
                        seen[b * (STEPS + 1) + int(min(max(float(sim), 0.0), 1.0) * STEPS)] += 1
                release()
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at // (STEPS + 1)), pa.array(at % (STEPS + 1)), pa.array(seen[at])], names=["b", "step", "n"])

        found = rows.mapInArrow(run, "b long, step long, n long").groupBy("b", "step").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("b").orderBy("step"))
        found = found.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy("b")))
        low = found.groupBy("b").agg(F.first("all").alias("n"), F.min(F.when(F.col("upto") * 100 >= F.col("all"), F.col("step"))).alias("step"))
        return {r["b"]: (r["n"], r["step"] / STEPS) for r in low.collect()}

    whole = {b: x for b, x in counted(False, frozenset()).items() if x[0] >= ENOUGH}
    found = whole | {b: x for b, x in counted(True, frozenset(whole)).items() if x[0] >= ENOUGH}
    floors, last = np.zeros(64), 0.0
    for b in range(64):
        last = max(last, REJECT_BELOW * (found[b][1] if b in found else 0.0))
        floors[b] = last
    return floors


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", batch_rows: int = 64) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected after its own columns.

    The model travels with the task: a fixed number of vectors for each language learned.
    """
    schema = T.StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                x = gram_counts(batch.column(text).to_pylist(), m.bits)
                grams = x.sum(1)
                if m.languages:
                    norms = np.sqrt(((x * m.idf) ** 2).sum(1))
                    sims = (x @ m.weights) / np.maximum(norms, 1e-12)[:, None]
                    best = sims.argmax(1)
                    score = np.clip(sims[np.arange(len(best)), best].astype(float), 0, 1)
                    lang = np.array(m.languages, object)[m.owner[best]]
                else:
                    score, lang = np.zeros(len(x)), np.full(len(x), UNKNOWN, object)
                none = grams == 0
                lang[none], score[none] = UNKNOWN, 0.0
                length = np.log2(np.maximum(grams, 1)).astype(int)
                rejected = none | (score < m.floors[length]) | (not m.languages)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=schema.fieldNames()
                )
            release()

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: the remainder of its id's checksum is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document."""
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows, back = set_aside(docs, "text")
    return predict(rows, model).filter(~F.col("rejected")).select(*back)
