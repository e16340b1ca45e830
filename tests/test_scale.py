"""Operators that spread what used to meet in one task: cells, quantiles, documents, keyed streams."""

import datetime
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkmill import registry
from inkmill.operators import retrieval
from inkmill.operators.cells import cell_search, choose_pivots
from inkmill.operators.quantiles import exact_quantiles
from inkmill.sources import files
from inkmill.streaming import ingest

from .oracle import connect, same


def test_cells_query_equals_its_sql(spark, sf_dir):
    same(registry.QUERIES["vector_cells"](spark, sf_dir), connect(sf_dir).sql(registry.ORACLE_SQL["vector_cells"]))


def _ranked(rows):
    return sorted((str(r.query_id), r["rank"], str(r.id), round(r.score, 7)) for r in rows.collect())


def test_fewer_than_half_of_clustered_cells_are_met(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 16))
    v = centers[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").repartition(4)
    asked = rows.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = cell_search(rows, asked, ("id",), 10)
    assert _ranked(found.hits) == _ranked(retrieval.vector_search(rows, asked, ("id",), 10))
    met, cells = found.met.selectExpr("sum(met)", "sum(cells)").first()
    print(f"{met} of {cells} cells met")
    assert cells >= 40 * 30 and met < cells / 2


@pytest.mark.parametrize("k", [1, 3, 200])
def test_cells_of_odd_vectors(spark, k):
    rng = np.random.default_rng(2)
    v = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(90, 3)))] + [(90, [0.0, 0.0, 0.0]), (91, None), (92, [1.0, 0.0, 0.0]), (93, [2.0, 0.0, 0.0]), (94, [1.0, 0.0, 0.0])]
    rows = spark.createDataFrame(v, "id long, embedding array<double>")
    asked = rows.filter("id >= 85").withColumnRenamed("id", "query_id")
    assert _ranked(cell_search(rows, asked, ("id",), k, cell_rows=8).hits) == _ranked(retrieval.vector_search(rows, asked, ("id",), k))
    assert cell_search(rows.limit(0), asked, ("id",), k).hits.count() == 0 == cell_search(rows, asked.limit(0), ("id",), k).hits.count()


def test_pivots_are_distinct():
    assert len(choose_pivots(np.array([[1.0, 0.0]] * 5 + [[0.0, 1.0]]), 4)) == 2


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=3000), "b": np.array([5.0]), "c": np.repeat([1.0, 2.0], 50), "d": np.exp(rng.normal(0, 200, 500)), None: rng.integers(0, 9, 77).astype(float), "f": np.array([-1e308, 1e308, 0.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("g", None), ("b", float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r.g: r for r in exact_quantiles(df, "g", "x", {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert [got[g].q1, got[g].m, got[g].q9] == pytest.approx(np.quantile(xs, [0.25, 0.5, 0.9]).tolist(), rel=1e-12), g
    assert exact_quantiles(df.limit(0), "g", "x", {"m": 0.5}).count() == 0


def test_a_document_of_many_rows(spark, tmp_path):
    rows = spark.range(500).repartition(7).select(F.format_string("%05d", "id").alias("key"), F.to_json(F.struct("id", F.lit('é "q"\n').alias("t"))).alias("json"))
    for path in (str(tmp_path / "d"), f"file://{tmp_path}/e"):
        files.write_document([("metadata", '{"a": 1}'), ("rows", rows), ("none", rows.limit(0)), ("copies", rows.limit(1).unionAll(rows.limit(1)))], path)
        found = json.loads((tmp_path / path[-1] / "document.json").read_text())
        assert [r["id"] for r in found["rows"]] == list(range(500)) and found["rows"][0]["t"] == 'é "q"\n'
        assert found["metadata"] == {"a": 1} and found["none"] == [] and len(found["copies"]) == 2
        assert spark.read.json(path).count() == 1
    files.write_document([("rows", rows.limit(2))], str(tmp_path / "d"))
    assert len(json.loads((tmp_path / "d/document.json").read_text())["rows"]) == 2


def test_a_key_is_kept_once_over_batches(spark, tmp_path):
    source, at = str(tmp_path / "in"), datetime.datetime(2020, 1, 1)
    schema = "document_id string, event string, at timestamp, v int"
    for i, rows in enumerate([[("d", "e", 0, 1), ("d", "f", 0, 2)], [("d", "e", 1, 3), ("x", "e", 1, 4)], [("d", "e", 2, 5), ("x", "f", 2, 6)]]):
        out = spark.createDataFrame([(d, e, at + datetime.timedelta(minutes=m), v) for d, e, m, v in rows], schema).coalesce(1)
        out.write.mode("append").parquet(source)
        stream = ingest.deduplicated(ingest.documents_stream(spark, source, schema), ["document_id", "event"], "at", "1 hour")
        ingest.extract_incrementally(stream, lambda b: b, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.schema(schema).parquet(str(tmp_path / "out/batch=*"))
    assert sorted(r.v for r in got.collect()) == [1, 2, 4, 6]


def test_python_steps_get_batches_bounded_in_bytes(spark, sf_dir):
    """Batches of registered queries' Python steps: 4 MB of 20 MB of texts, not 10 000 rows of any length."""
    from inkmill.functions import html

    @F.pandas_udf("long")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    out = registry.QUERIES["html_extract"](spark, sf_dir)
    assert out.filter("content IS NOT NULL").count() > 0
    long = spark.range(200, numPartitions=1).select(F.concat(F.lit("<p>a &amp; "), F.repeat(F.lit("b"), 100_000)).alias("t"))
    assert long.agg(F.max(rows("t"))).first()[0] <= 60
    assert long.filter(F.length(html.xml_text(F.col("t"))) == 100_004).count() == 200
