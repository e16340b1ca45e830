import json

from pyspark.sql import functions as F

from inkmill import models
from inkmill.operators import documents, retrieval
from inkmill.plans import __main__ as cli
from inkmill.plans import jobs
from inkmill.schemas import ARCHIVE_META, DOCUMENT, EXTRACTION, LABEL, RUN
from inkmill.sources import api, files
from inkmill.streaming import ingest


def test_arrays_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "é"), ("b", None)], "id string, content string")
    files.write_array(rows, str(tmp_path / "x.json"))
    text = (tmp_path / "x.json").read_text()
    assert '\n  {\n    "id": "a",\n    "content": "é"\n  },' in text
    assert sorted(map(tuple, files.read_array(spark, str(tmp_path / "x.json"), "id string, content string").collect())) == [("a", "é"), ("b", None)]
    assert files.read_if_there(spark, str(tmp_path / "none.json"), DOCUMENT).count() == 0


def test_records_and_lists(spark, tmp_path):
    for name in ("b.json", "a.json", "all.json"):
        (tmp_path / name).write_text(json.dumps({"event": name}, indent=1))
    rows = files.read_records(spark, str(tmp_path), "event string", without=["all.json"]).orderBy("file_name").collect()
    assert [r.event for r in rows] == ["a.json", "b.json"]
    assert {r.name for r in files.list_files(spark, str(tmp_path)).collect()} == {"a.json", "b.json", "all.json"}
    (tmp_path / "l").mkdir()
    (tmp_path / "l/labels.json").write_text(json.dumps({"annotations": [{"id": 1, "rating": "Consistent"}], "summary": {}}))
    assert files.read_labels(spark, str(tmp_path / "l/labels.json"), LABEL).first().rating == "Consistent"


def test_event_partitions_are_replaced_one_by_one(spark, tmp_path):
    row = lambda doc, tone: (doc, "T", "Book", "Other Event", "A", ["c"], (None, None), tone)
    out = str(tmp_path / "events")
    files.write_events(spark.createDataFrame([row("d1", "x"), row("d2", "x")], EXTRACTION), out)
    files.write_events(spark.createDataFrame([row("d2", "y")], EXTRACTION), out)
    got = spark.read.json(out).select("document_id", "event_slug", "tone").collect()
    assert sorted(map(tuple, got)) == [("d1", "other_event", "x"), ("d2", "other_event", "y")]
    files.write_envelopes(spark, spark.createDataFrame([row("d1", "x")], EXTRACTION), spark.createDataFrame([row("d2", "y")], EXTRACTION), {"model_used": "m"}, str(tmp_path / "run"))
    run = spark.read.schema(RUN).json(str(tmp_path / "run/all"))
    from inkmill.operators.claims import flatten_run

    assert flatten_run(run, "gutenberg").first().tone == "y" and run.first().metadata.model_used == "m"


def test_only_new_rows_are_appended(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (2, 4):
        files.append_new(spark.range(n).withColumn("v", F.lit(n)), path, ["id"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(0, 2), (1, 2), (2, 4), (3, 4)]


def test_index_is_built_once(spark, tmp_path):
    units = spark.createDataFrame([(1, "fort sumter"), (2, "other words"), (3, "more")], "id int, text string")
    assert files.load_index(spark, str(tmp_path / "i"), ("id",)) is None
    files.load_or_build(spark, str(tmp_path / "i"), ("id",), units)
    index = files.load_or_build(spark, str(tmp_path / "i"), ("id",), units.limit(0))
    asked = spark.createDataFrame([(0, "sumter")], "query_id int, query string")
    assert [r.id for r in retrieval.keyword_search(index, asked).collect()] == [1]


def test_api_source_reads_replies_and_stubs(spark):
    item = {"item": {"title": "Letter of A to B, x", "type": "Letter", "contributor_names": ["A"]}}
    stored = api.StoredReplies({"https://h/item/a1/?fo=json": json.dumps(item)})
    rows = {r.id: r for r in api.archive_items(spark, ["https://h/item/a1/", "https://h/item/a2/"], stored, pause=0).collect()}
    assert (rows["a1"].title, rows["a1"].document_type, rows["a1"]["from"], rows["a1"]["to"]) == ("Letter of A to B, x", "Letter", "A", "B")
    assert (rows["a2"].title, rows["a2"].document_type, rows["a2"].error is not None) == ("a2", "Document", True)
    reply = {"results": [{"id": 7, "title": "T", "authors": [{"name": "X, Y"}, {"name": "Z"}], "formats": {"text/plain": "p", "text/plain; charset=utf-8": "u"}}]}
    book = api.books(spark, [7, 8], "https://b/books", api.StoredReplies({"https://b/books?ids=7,8": json.dumps(reply)})).first()
    assert tuple(book) == (7, "T", "X, Y, Z", "u")


def test_command_line(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "gutenberg").mkdir(parents=True)
    (raw / "loc").mkdir()
    (raw / "gutenberg/_metadata.json").write_text(json.dumps([{"id": 7, "title": "T", "authors": "Ketcham, Henry", "reference": "r"}]))
    (raw / "gutenberg/7_t.txt").write_text("a\nb")
    (raw / "loc/_metadata.json").write_text(json.dumps([{"id": "m", "files": ["data/m.txt"], "title": "L", "document_type": "Letter"}]))
    (raw / "loc/m.txt").write_text("words")
    cli.main(["all", "--raw", str(raw), "--processed", str(tmp_path / "p")])
    docs = jobs.combine_dataset(spark, str(tmp_path / "p"))
    assert {r.id: (r.source, r.content) for r in docs.collect()} == {"gutenberg_7": ("gutenberg", "a b"), "loc_m": ("loc", "words")}
    assert files.read_metadata(spark, str(raw / "loc/_metadata.json"), ARCHIVE_META).count() == 1
    assert documents.report(docs, "source").count() == 2


def test_retries():
    waits = []

    class Busy:
        n = 0

        def complete(self, prompt):
            self.n += 1
            if self.n < 3:
                raise models.RateLimited("429")
            return '```json\n{"a": 1}\n```'

    assert models.Retry(sleep=waits.append).call(Busy(), "p") == ('{"a": 1}', None)
    assert waits == [60, 120]

    class Text:
        n = 0

        def complete(self, prompt):
            self.n += 1
            return "not json"

    t = Text()
    assert models.Retry(sleep=waits.append).call(t, "p")[0] is None and t.n == 1
    assert models.Retry(everything=True, sleep=waits.append).call(t, "p")[0] is None and t.n == 4
    assert models.Retry().call(Text(), "p", want_json=False) == ("not json", None)


def test_evaluation_job(spark):
    rows = spark.createDataFrame(
        [(0, "loc", "d0", "t", "Gettysburg Address", "A", ["the nation was conceived in liberty"]), (1, "gutenberg", "d1", "u", "Gettysburg Address", "B", ["conceived in liberty"])],
        "doc_ord int, source string, document_id string, document_title string, event string, author string, claims array<string>",
    )
    scores = jobs.evaluate(spark, rows, models.OverlapJudge(), runs=2)
    assert scores.count() == 6 and {r.score for r in scores.collect()} == {100}
    labels = spark.createDataFrame([("Gettysburg Address", "B", "Consistent")], "event string, author string, rating string")
    assert {r.agreement for r in jobs.inter_rater(labels, scores).collect()} == {1.0}

    class Lists:
        def complete(self, prompt):
            return 'here: ["a", "b"]' if "Gettysburg" in prompt else "none"

    from inkmill.schemas import events

    got = models.expand_queries(events(spark), Lists()).groupBy("event").count().collect()
    assert {r.event: r["count"] for r in got}["Gettysburg Address"] == 2 and len(got) == 5


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"))
    work = lambda batch: batch.select("doc_id", F.length("text").alias("n"))
    rows(0, 3).write.parquet(source)
    run = lambda: ingest.extract_incrementally(ingest.documents_stream(spark, source, "doc_id long, text string"), work, out, ck, ["doc_id"], ["doc_id"])
    run()
    rows(2, 5).write.mode("append").parquet(source)
    run()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
