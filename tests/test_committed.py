"""Committed tables with several writers, and the ledger of replies."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from inkmill import models
from inkmill.plans import jobs
from inkmill.sources import files
from inkmill.sources.committed import CommittedTable, Store
from inkmill.sources.ledger import ReplyLedger


def test_a_file_is_put_once(spark, tmp_path):
    store, won = Store(spark), []
    for path in (f"file://{tmp_path}/a/x.json", str(tmp_path / "b/x.json")):
        threads = [threading.Thread(target=lambda i=i: won.append((path, i)) if store.put_if_absent(path, f"writer {i}") else None) for i in range(8)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len([w for w in won if w[0] == path]) == 1
        assert store.read(path) == f"writer {dict(won)[path]}" and store.names(os.path.dirname(path)) == ["x.json"]


def test_two_writers_append_no_key_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    n = []

    def write(lo):
        rows = spark.range(lo, lo + 60).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 9).alias("k"), F.lit(lo).alias("by"))
        n.append(CommittedTable(spark, path, rows.schema).append(rows, ["k"]))

    threads = [threading.Thread(target=write, args=(lo,)) for lo in (0, 20, 40)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = CommittedTable(spark, path, "id long, k long, by int")
    rows = table.read().collect()
    assert sorted((r.k is None, r.k) for r in rows) == [(False, i) for i in range(9)] + [(True, None)] and sum(n) == 10
    assert table.append(spark.range(5).select("id", (F.col("id") % 9).alias("k"), F.lit(9).alias("by")), ["k"]) == 0


def test_readers_see_versions_and_dead_writers_leave_nothing(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "id long")
    assert table.read().count() == 0 and table.snapshot().version == 0
    table.append(spark.range(3))
    before = table.snapshot()
    table.write_part(spark.range(100))  # written, and never committed
    table.append(spark.range(3, 5), note="x")
    assert table.read().count() == 5 and table.read(before).count() == 3 and table.snapshot().parts[-1]["note"] == "x"
    assert not table.commit(before, [])
    assert table.compact() == 2 and sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3, 4] and len(table.snapshot().parts) == 1
    assert table.read(before).count() == 3
    assert table.vacuum(3600) == 0 and table.vacuum(-5) == 3 and table.read().count() == 5
    assert table.compact() == 0


def test_vectors_appended_at_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(5)] + [(9, None)], "id long, embedding array<double>")
    files.save_vectors(rows.limit(2), str(tmp_path / "v"), ("id",))
    files.save_vectors(rows, str(tmp_path / "v"), ("id",), append=True)
    got = files.load_vectors(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, got.collect())) == [(i, [0.6, 0.8]) for i in range(5)]
    assert files.read_committed(spark, str(tmp_path / "v"), "id long").count() == 5


class Counted:
    """Replies to a prompt, notes each call in a folder that all tasks see, and dies at some prompts."""

    def __init__(self, folder, dies=(), fails=()):
        self.folder, self.dies, self.fails = str(folder), dies, fails

    def complete(self, prompt, temperature=None):
        if prompt in self.dies:
            raise SystemExit("executor lost")  # not an error of the call: the task dies
        if prompt in self.fails:
            raise ValueError("no reply")
        fd = os.open(f"{self.folder}/calls", os.O_CREAT | os.O_APPEND | os.O_WRONLY)
        os.write(fd, f"{prompt}\n".encode())
        os.close(fd)
        return f'{{"n": {len(prompt)}, "t": {temperature or 0}}}'

    def calls(self):
        path = f"{self.folder}/calls"
        return sorted(open(path).read().split("\n")[:-1]) if os.path.exists(path) else []


def test_a_job_that_was_killed_pays_only_for_the_rest(spark, tmp_path):
    prompts = [f"prompt {i:03d}" for i in range(60)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts + prompts[:10])] + [(99, None)], "id int, prompt string").repartition(4)
    ledger = ReplyLedger(spark, str(tmp_path / "ledger"), wave=10, slots=2)
    with pytest.raises(Exception):
        ledger.completer(Counted(tmp_path, dies={"prompt 031"}), "m")(rows).collect()
    paid = ledger.table.read().count()
    model = Counted(tmp_path)
    assert 0 < paid < 60
    got = {r.id: r.reply for r in ledger.completer(model, "m")(rows).collect()}
    assert got == {i: '{"n": 10, "t": 0}' for i in range(70)} | {99: None}
    # every prompt once, but for those of the wave that was lost
    assert set(model.calls()) == set(prompts) and len(model.calls()) <= 60 + 15 and ledger.known().count() == 60
    n = len(model.calls())
    ledger.completer(model, "m")(rows).collect()
    assert len(model.calls()) == n and ledger.calls().first().calls == 60


def test_what_tells_calls_apart(spark, tmp_path):
    rows = spark.createDataFrame([("p", r) for r in range(5)], "prompt string, run int")
    ledger, model = ReplyLedger(spark, str(tmp_path / "ledger")), Counted(tmp_path)
    assert {r.reply for r in ledger.completer(model, "m", temperature=0.5, apart=("run",))(rows).collect()} == {'{"n": 1, "t": 0.5}'}
    assert len(model.calls()) == 5
    ledger.completer(model, "m", temperature=0.5)(rows).collect()
    ledger.completer(model, "m", temperature=0.0)(rows).collect()
    ledger.completer(model, "other", temperature=0.0)(rows).collect()
    assert len(model.calls()) == 8
    failing = Counted(tmp_path, fails={"q"})
    asked = spark.createDataFrame([("p",), ("q",)], "prompt string")
    errors = {r.prompt: (r.reply is None, r.error) for r in ledger.completer(failing, "f")(asked).collect()}
    assert errors == {"p": (False, None), "q": (True, "ValueError: no reply")}
    assert {r.prompt: r.error for r in ledger.completer(model, "f")(asked).collect()} == {"p": None, "q": None}


def test_runs_at_a_temperature_are_calls_of_their_own(spark, tmp_path):
    records = spark.createDataFrame(
        [(0, "loc", "d", "t", "Letter", "Gettysburg Address", "L", ["a b"]), (1, "gutenberg", "e", "u", "Book", "Gettysburg Address", "B", ["a c"])],
        "doc_ord int, source string, document_id string, document_title string, document_type string, event string, author string, claims array<string>",
    )

    class Judge(Counted):
        def complete(self, prompt, temperature=None):
            super().complete(prompt.replace("\n", " "), temperature)
            return f'{{"consistency_score": {temperature * 100 if temperature is not None else -1}, "contradictions": [], "reasoning": ""}}'

    model, ledger = Judge(tmp_path), ReplyLedger(spark, str(tmp_path / "ledger"))
    for _ in range(2):
        rows = jobs.self_consistency(spark, records, model, ledger).collect()
        assert [(r.valid_runs, r["mean"], r["std"]) for r in rows] == [(5, 50.0, 0.0)] * 3
    assert len(model.calls()) == 15
    assert {r.score for r in jobs.evaluate(spark, records, model, **jobs.INTER_RATER).collect()} == {0.0}
    assert {r.score for r in jobs.evaluate(spark, records, model).collect()} == {-1.0}


def test_defaults_of_the_retrieval_job(spark):
    from inkmill.operators import documents

    docs = spark.createDataFrame([("a", None, None, None, "x"), ("b", "T", "Book", None, "y"), ("c", "T", "Speech", "Hay", "z")], "id string, title string, document_type string, `from` string, content string")
    assert [tuple(r) for r in documents.for_hybrid(docs).orderBy("id").collect()] == [
        ("a", "Unknown", "Letter", "Abraham Lincoln", "x"), ("b", "T", "Book", "Unknown Author", "y"), ("c", "T", "Speech", "Hay", "z"),
    ]
    rows = jobs.hybrid_pipeline(spark, docs, models.KeywordCompleter({}), models.HashingEmbedder())
    assert {r.document_id: r.author for r in rows.collect()} == {"a": "Abraham Lincoln", "b": "Unknown Author", "c": "Hay"}
