import math

import pytest
from pyspark.sql import functions as F

from inkmill.operators import agreement, chunking, claims, documents, evaluation, extraction, retrieval
from inkmill.schemas import EVENTS, events


def python_spans(n, text, size, overlap):
    out, start = [], 0
    while start < n:
        end = start + size
        if end < n:
            at = text.rfind("\n\n", start + size - overlap, end)
            at = at if at >= 0 else text.rfind(". ", start + size - overlap, end)
            end = at + 2 if at >= 0 else end
        out.append((start, end))
        start = end - overlap
        if start >= n - overlap:
            break
    return out


@pytest.mark.parametrize("text", ["A" * 20000, "", None, "short", "ab. cd\n\nef. " * 700, " " * 9000, "é. ü\n\n" * 3000])
def test_chunks(spark, text):
    rows = chunking.chunk_documents(spark.createDataFrame([(1, text)], "doc_id int, content string")).orderBy("chunk_id").collect()
    wanted = [(s, e) for s, e in python_spans(len(text or ""), text or "", 4000, 800) if text[s:e].strip()]
    assert [(r.start_char, r.end_char) for r in rows] == wanted
    assert [r.text for r in rows] == [text[s:e].strip() for s, e in wanted]
    assert [r.chunk_id for r in rows] == list(range(len(rows)))


def test_batches_are_numbered_from_one(spark):
    rows = chunking.batch_documents(spark.createDataFrame([(1, "A" * 100000)], "doc_id int, content string")).collect()
    assert [(r.batch_num, r.end_char) for r in rows] == [(1, 120000)]


CHUNKS = [("a", 0, "Lincoln spoke at Gettysburg."), ("a", 1, "He attacked the problem at the sea."), ("b", 2, "Fort Sumter was attacked in April.")]


def test_keyword_search_drops_zero_scores(spark):
    units = spark.createDataFrame(CHUNKS, "doc_id string, chunk_id int, text string")
    index = retrieval.keyword_index(units, ("doc_id", "chunk_id"))
    asked = spark.createDataFrame([("q", "Fort Sumter attack", "a")], "query_id string, query string, book string")
    hits = retrieval.keyword_search(index, asked, 2).collect()
    assert [(h.doc_id, h.chunk_id, h.rank) for h in hits] == [("b", 2, 1)]
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    length = {0: 4, 1: 7, 2: 6}
    w = idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length[2] / (sum(length.values()) / 3)))
    assert hits[0].score == pytest.approx(2 * w)
    assert retrieval.keyword_search(index, asked, 2, only=("book", "doc_id")).count() == 0
    assert retrieval.keyword_search(index, asked.filter("false")).count() == 0


def test_vector_search_filters_after_the_cut(spark):
    vectors = spark.createDataFrame([(i, "x" if i < 5 else "y", [1.0, i / 100]) for i in range(10)] + [(99, "x", None)], "id int, doc string, embedding array<double>")
    asked = spark.createDataFrame([(0, "y", [1.0, 0.0])], "query_id int, doc_wanted string, embedding array<double>")
    assert [r.id for r in retrieval.vector_search(vectors, asked, ("id",), 3).orderBy("rank").collect()] == [0, 1, 2]
    hits = retrieval.vector_search(vectors, asked, ("id", "doc"), 2, only=("doc_wanted", "doc")).collect()
    assert [(r.id, r["rank"]) for r in hits] == [(5, 1)]  # 6 nearest first, of which one is of the wanted document


def test_fusion(spark):
    v = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, k string, rank int")
    w = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query_id string, k string, rank int")
    rows = retrieval.fuse(v, w, ("k",)).orderBy("rank").collect()
    assert [r.k for r in rows] == ["b", "a", "c"]
    assert rows[0].score == pytest.approx(0.5 / 62 + 0.5 / 61)


def test_documents(spark):
    meta = spark.createDataFrame([(7, " A\nTitle ", "Ketcham, Henry"), (8, "No file", "x")], "id int, title string, authors string")
    texts = spark.createDataFrame([("/d/7_a.txt", "one\ntwo"), ("/d/7_b.txt", "other")], "path string, value string")
    (book,) = documents.book_documents(meta, texts).collect()
    assert (book.id, book.title, book["from"], book.content, book.document_type) == ("gutenberg_7", "A Title", "Henry Ketcham", "one two", "Book")
    archive = spark.createDataFrame(
        [("m1", ["x.pdf", "d/m1.txt"], "Meta title", "Letter", "1860", None, "Hay, John", None), ("m2", ["x.pdf"], "t", "Letter", None, None, None, None)],
        "id string, files array<string>, title string, document_type string, date string, place string, `from` string, `to` string",
    )
    (doc,) = documents.archive_documents(archive, spark.createDataFrame([("/raw/m1.txt", "short")], "path string, value string")).collect()
    assert (doc.id, doc.title, doc.date, doc["from"], doc.document_type) == ("loc_m1", "Meta title", "1860", "John Hay", "Document")
    both = documents.combine(spark.createDataFrame([("gutenberg_1",)], "id string"), spark.createDataFrame([("loc_1",), ("z",)], "id string"))
    assert {r.id: r.source for r in both.collect()} == {"gutenberg_1": "gutenberg", "loc_1": "loc", "z": None}
    stub = documents.with_stub(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "id string, title string, document_type string"), "id").first()
    assert (stub.title, stub.document_type) == ("a", "Document")


def test_first_match(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    found, missing = documents.first_match(left, right, "k", "v")
    assert [r.v for r in found.collect()] == ["a"] and [r.k for r in missing.collect()] == [2]


def test_claims(spark):
    rows = spark.createDataFrame(
        [(1, "e1", None, ["x"], "t1", "d1"), (0, "e1", "A", ["y", "y"], "t0", "d0"), (2, "e1", "A", ["z"], "t2", "d2"), (3, "e1", "A", [], "t3", "d3"), (4, "no", "A", ["w"], "t4", "d4")],
        "doc_ord int, event string, author string, claims array<string>, document_title string, document_id string",
    )
    dimension = spark.createDataFrame([("e1",), ("e2",)], "event string")
    got = {(r.event, r.author): (r.claims, r.doc_title) for r in claims.author_claims(rows, dimension).collect()}
    assert got == {("e1", "Unknown"): (["x"], "t1"), ("e1", "A"): (["y", "y", "z"], "t0")}
    primary = claims.primary_claims(rows, dimension)
    assert primary.first().claims == ["y", "y", "x", "z"]
    pairs = claims.comparison_pairs(primary, claims.author_claims(rows, dimension)).collect()
    assert sorted(p.doc_info for p in pairs) == ["t0 (d0)", "t1 (d1)"]


GOLDEN = [
    ("Consistent", 75, 75, 40), ("Consistent", 75, 75, 75), ("Consistent", 75, 75, 75), ("Consistent", 75, 75, 75), ("Not Consistent", 40, 75, 40),
    ("Consistent", 95, 95, 95), ("Consistent", 95, 95, 85), ("Not Consistent", 75, 80, 55), ("Consistent", 75, 75, 75), ("Consistent", 95, 95, 95),
]


def test_agreement_of_the_stored_ratings(spark):
    long = [(i, r[0], s, r[j + 1], j) for i, r in enumerate(GOLDEN) for j, s in enumerate(evaluation.STRATEGIES)]
    rows = spark.createDataFrame(long, "id int, rating string, strategy string, score int, strategy_ord int")
    rated = rows.withColumn("human", agreement.consistent(F.col("rating"))).withColumn("judge", agreement.reaches(F.col("score")))
    summary = agreement.agreement(rated, ["strategy", "strategy_ord"], places=12)
    got = {r.strategy: (r.tn, r.fp, r.fn, r.tp, r.agreement, r.kappa) for r in summary.collect()}
    assert got["zero_shot"] == (1, 1, 0, 8, 0.9, pytest.approx(8 / 13))
    assert got["chain_of_thought"] == (0, 2, 0, 8, 0.8, 0.0)
    assert got["few_shot"] == (2, 0, 1, 7, 0.9, pytest.approx(14 / 19))
    assert agreement.best_strategy(summary).first().strategy == "few_shot"
    same = spark.createDataFrame([(1, 1)], "human int, judge int")
    assert agreement.agreement(same, []).first().kappa is None


def test_self_consistency(spark):
    runs = spark.createDataFrame(
        [("e", "a", "zs", 0, 70.0), ("e", "a", "zs", 1, 90.0), ("e", "a", "zs", 2, None), ("e", "a", "fs", 0, None)], "event string, author string, prompt_type string, run int, score double"
    )
    got = {r.prompt_type: r for r in evaluation.self_consistency(runs).collect()}
    assert (got["zs"]["mean"], got["zs"]["std"], got["zs"]["range"], got["zs"].valid_runs, got["zs"].errors) == (80.0, 10.0, 20.0, 2, 1)
    assert (got["fs"]["mean"], got["fs"]["std"], got["fs"].valid_runs, got["fs"].errors) == (None, None, 0, 1)
    assert {r.prompt_type: r.scores for r in evaluation.run_scores(runs).collect()} == {"zs": [70.0, 90.0], "fs": []}


def test_histogram_closes_its_last_bin(spark):
    values = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    assert {r.bin: r.n for r in evaluation.histogram(values, "v").collect()} == {**{i: 1 for i in range(9)}, 9: 2}
    assert evaluation.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").first().n == 2


def test_assembly_and_records(spark):
    pairs = spark.createDataFrame([("d", "Fort Sumter Decision", "T", "A"), ("d", "Other", "T", "A")], "doc_id string, event string, title string, author string")
    found = spark.createDataFrame([("d", "Fort Sumter Decision", 2, ["z"]), ("d", "Fort Sumter Decision", 1, ["x", "", "y"]), ("d", "Other", 1, [])], "doc_id string, event string, batch_num int, excerpts array<string>")
    got = {r.event: r.text for r in extraction.assemble(pairs, found).collect()}
    assert got["Other"] == "No information found."
    assert got["Fort Sumter Decision"] == (
        "# INTERMEDIATE EXTRACTION\n\n# EVENT: fort_sumter_decision\n\n# BOOK: T\n\n# AUTHOR: A\n\n\n## CHUNK 1\nx\n\ny\n\n\n## CHUNK 2\nz\n\n\n# END"
    )


class Broken:
    def complete(self, prompt):
        raise ValueError("no")


def test_failed_replies_become_empty_records(spark):
    from inkmill.models import Retry, complete_with

    docs = spark.createDataFrame([("d", "T", "Book", "A", "text of a book")], "id string, title string, document_type string, author string, content string")
    complete = complete_with(Broken(), Retry(tries=1))
    rows = extraction.batched(docs, events(spark), complete).collect()
    assert sorted(r.event for r in rows) == sorted(EVENTS)
    assert {(r.tone, len(r.claims), r.document_id) for r in rows} == {("Not mentioned", 0, "d")}
    assert extraction.direct(docs, complete).count() == 0
    assert extraction.direct(docs, complete, events(spark)).count() == 5
    hits = spark.createDataFrame([("d", EVENTS[0], 1, "p")], "id string, event string, rank int, text string")
    pairs = extraction.with_events(docs.drop("content"), events(spark).select("event"))
    tones = {r.event: r.tone for r in extraction.retrieved(pairs, hits, complete).collect()}
    assert tones[EVENTS[0]] == "Error in extraction" and set(tones.values()) == {"Error in extraction", "Not mentioned"}


def test_author_ranks_are_numbered_by_range(spark):
    rows = [("e", f"a{i}", s, float(i * 7 % 50 + k)) for i in range(400) for k, s in enumerate(evaluation.STRATEGIES)]
    scores = spark.createDataFrame(rows, "event string, author string, prompt_type string, score double")
    out = evaluation.author_ranking(evaluation.widen(scores))
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(out.collect(), key=lambda r: r.rank)
    assert [r.rank for r in got] == list(range(1, 401))
    assert [r.author for r in got] == [r.author for r in sorted(got, key=lambda r: (-r.avg_score, r.author))]
    assert evaluation.author_ranking(evaluation.widen(scores.limit(0))).count() == 0


def test_default_ids_lose_no_row_over_many_partitions(spark):
    from inkmill.operators import documents

    rows = [(None if i % 5 else f"have{i}", (i * 7919) % 10007, "x" * 200) for i in range(4000)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        got = documents.with_default_id(spark.createDataFrame(rows, "id string, place int, text string"), "n", "place").select("id", "place").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    missing = sorted(p for i, p, _ in rows if i is None)
    assert sorted((r.id, r.place) for r in got) == sorted([(i, p) for i, p, _ in rows if i] + [(f"n{k}", p) for k, p in enumerate(missing)])


class _Counting:
    """Replies as the offline completer does, and writes a file for each call."""

    def __init__(self, folder):
        from inkmill.models import KeywordCompleter

        self.folder, self.inner = str(folder), KeywordCompleter({})

    def complete(self, prompt, temperature=None):
        import os
        import uuid

        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        return self.inner.complete(prompt)


class _CountingEmbedder:
    def __init__(self, folder):
        from inkmill.models import HashingEmbedder

        self.folder, self.inner = str(folder), HashingEmbedder()

    def embed(self, texts):
        import os
        import uuid

        for _ in texts:
            open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        return self.inner.embed(texts)


def _some_documents(spark):
    book = "On Election Night 1860 the returns came in. Fort Sumter was a hard decision. " * 400
    rows = [("gutenberg_1", "One", "Book", "A", book), ("gutenberg_2", "Two", "Book", "B", book[:20000]), ("loc_1", "Three", "Letter", "C", "Of the Gettysburg Address.")]
    return spark.createDataFrame(rows, "id string, title string, document_type string, `from` string, content string")


def test_each_prompt_is_asked_once(spark, tmp_path):
    from inkmill.operators import chunking
    from inkmill.plans import jobs

    docs = _some_documents(spark)
    batches = chunking.batch_documents(docs.filter("document_type = 'Book'"), doc_id="id").count()
    records = jobs.batched_pipeline(spark, docs, _Counting(tmp_path)).collect()
    asked = sum(1 for r in records if r.tone != "Not mentioned" and r.document_id.startswith("gutenberg"))
    assert batches + asked + 1 <= len(list(tmp_path.iterdir())) <= batches + 10 + 1


def test_each_text_is_embedded_once(spark, tmp_path):
    from inkmill.models import KeywordCompleter
    from inkmill.operators import chunking
    from inkmill.plans import jobs

    docs = _some_documents(spark)
    chunks = chunking.chunk_documents(docs.filter("document_type = 'Book'"), doc_id="id").count()
    calls, index = tmp_path / "calls", tmp_path / "index"
    calls.mkdir()
    run = lambda: jobs.hybrid_pipeline(spark, docs, KeywordCompleter({}), _CountingEmbedder(calls), str(index)).collect()
    first = run()
    assert len(list(calls.iterdir())) == chunks + 5
    assert sorted(map(str, run())) == sorted(map(str, first))
    assert len(list(calls.iterdir())) == chunks + 10  # the index was loaded; only the queries were embedded again


def test_direct_fills_missing_events(spark):
    from inkmill import models, schemas
    from inkmill.operators import extraction

    docs = spark.createDataFrame([("d", "T", "Letter", "A", "text"), ("e", "U", "Letter", "B", "")], "id string, title string, document_type string, author string, content string")

    class Half:
        def complete(self, prompt, temperature=None):
            if "Document: U" in prompt:
                raise ValueError("no")
            return '{"extractions": [{"event": "Gettysburg Address", "author": "A", "claims": ["c"], "tone": "t"}]}'

    rows = extraction.direct(docs, models.complete_with(Half()), schemas.events(spark)).collect()
    assert sorted((r.document_id, r.event) for r in rows) == sorted((d, e) for d in "de" for e in schemas.EVENTS)
    assert [(r.event, r.claims) for r in rows if r.claims] == [("Gettysburg Address", ["c"])]


def test_judges_differ_by_strategy_and_keep_fractions(spark):
    from inkmill import models

    class Judge:
        def complete(self, prompt, temperature=None):
            score = 1.5 if "Example:" in prompt else 2.5 if "step by step" in prompt else 85.5
            return f'{{"consistency_score": {score}, "reasoning": "{temperature}"}}'

    work = spark.createDataFrame([("e", ["p"], "a", ["q"], s) for s in ("zero_shot", "chain_of_thought", "few_shot", "other")], "event string, primary_claims array<string>, author string, author_claims array<string>, prompt_type string")
    got = {r.prompt_type: (r.score, r.reasoning) for r in models.judge(work, Judge(), temperature=0.5).collect()}
    assert got == {"zero_shot": (85.5, "0.5"), "chain_of_thought": (2.5, "0.5"), "few_shot": (1.5, "0.5"), "other": (None, None)}


def test_extraction_job_writes_its_sinks(spark, tmp_path):
    import json

    from inkmill.models import HashingEmbedder, KeywordCompleter
    from inkmill.plans import jobs
    from inkmill.schemas import DOCUMENT
    from inkmill.sources import files

    docs = _some_documents(spark)
    full = spark.createDataFrame([], DOCUMENT).unionByName(docs, allowMissingColumns=True)
    files.write_rows(full.filter("document_type = 'Book'"), str(tmp_path / "in" / "books"))
    files.write_rows(full.filter("document_type <> 'Book'"), str(tmp_path / "in" / "archive"))
    for name, embedder in (("batched", None), ("hybrid", HashingEmbedder())):
        out = str(tmp_path / name)
        jobs.run_extraction(spark, str(tmp_path / "in"), out, KeywordCompleter({}), embedder)
        assert spark.read.json(f"{out}/events").count() == 2 * 5 + 5
        meta = json.loads(spark.read.text(f"{out}/runs/all").first()[0])["metadata"]
        assert (meta["loc_documents_processed"], meta["gutenberg_documents_processed"]) == (1, 2)


def test_small_reports(spark, tmp_path):
    from inkmill.operators import claims, documents
    from inkmill.sources import files

    items = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, files array<string>")
    assert [r.n_files for r in documents.files_per_item(items).orderBy("id").collect()] == [2, 0]
    assert tuple(claims.events_in_pairs(spark.createDataFrame([("x",), ("x",), ("y",)], "event string")).first()) == (2, 3)
    for n in ("b.txt", "a.txt"):
        (tmp_path / n).write_text(n)
    assert [r.name for r in files.list_files(spark, str(tmp_path)).collect()] == ["a.txt", "b.txt"]
    scores = spark.createDataFrame([("e", "a", "zero_shot", 1.0, None, "r")], "event string, author string, prompt_type string, score double, contradictions array<string>, reasoning string")
    files.write_nested(scores, str(tmp_path / "nested"), ["zero_shot", "few_shot"])
    assert spark.read.json(str(tmp_path / "nested")).first().results.zero_shot.score == 1.0
