import pytest

from inkmill import registry

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    same(registry.QUERIES[name](spark, sf_dir), con.sql(registry.ORACLE_SQL[name]))


def test_extraction_has_a_record_for_each_book_and_event(spark, sf_dir):
    books = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars > 4000").count()
    for name in ("extract_batched", "extract_hybrid"):
        rows = registry.QUERIES[name](spark, sf_dir).filter("document_type = 'Book'")
        assert rows.count() == 5 * books == rows.select("document_id", "event").distinct().count()
        assert rows.filter("size(claims) > 0").count() > 0


def test_html_query_reads_every_page(spark, sf_dir):
    rows = registry.QUERIES["html_extract"](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count() == rows.filter("content <> ''").count()


def test_judge_query_scores_every_pair(spark, sf_dir):
    pairs = registry.QUERIES["comparison_pairs"](spark, sf_dir).count()
    rows = registry.QUERIES["judge_pairs"](spark, sf_dir)
    assert rows.count() == 3 * pairs
    assert rows.filter("score BETWEEN 0 AND 100 AND error IS NULL").count() == 3 * pairs


def test_embeddings_are_of_length_one(spark, sf_dir):
    from inkmill.functions.vectors import norm

    rows = registry.QUERIES["embed_documents"](spark, sf_dir)
    far = rows.select(norm(rows.embedding).alias("n")).filter("n > 0 AND abs(n - 1) > 1e-5")
    assert far.count() == 0


def test_stream_keeps_every_row(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(3).drop("doc_id", "text")
    texts = spark.createDataFrame([(None, "a"), (None, "b c"), (1, "a b"), (1, "a b c d")], "doc_id long, text string")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    texts.crossJoin(docs.limit(1)).select(*schema.fieldNames()).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["stream_ingest"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 2), (False, 4), (True, 1), (True, 2)]
