"""Data-set build, the two extraction pipelines and the evaluation, as plans over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import models
from ..functions import html
from ..functions.links import archive_id, image_extension, safe_filename, url_type
from ..functions.prompts import event_query
from ..functions.text import or_else
from ..operators import agreement, chunking, claims, documents, evaluation, extraction, retrieval
from ..schemas import ARCHIVE_META, BOOK_META, DOCUMENT, events
from ..shared import new_folder, small_batches
from ..sources import api, download, files
from ..sources.download import Downloads
from ..sources.ledger import ReplyLedger

# Where books are listed, and seconds between two requests to the archive.
BOOK_API, ARCHIVE_PAUSE = "https://gutendex.com/books", 3.5


def fetch_books(spark: SparkSession, ids: list[int], raw: str, fetcher=None, base: str = BOOK_API) -> DataFrame:
    """Writes each book's text as ``{id}_{title}.txt`` under ``raw``/gutenberg, and the sidecar of their metadata. Returns
    (id, title, name, error); a book without a plain text or whose download fails has no file. What was fetched is
    kept under ``raw``/_downloads, so that a second call fetches only what is missing."""
    downloads = Downloads(spark, f"{raw}/_downloads", fetcher)
    listed = downloads.get(spark.createDataFrame([(api.books_url(ids, base),)], "url string"))
    found = api.books_of(listed.select("url", F.make_valid_utf8(F.col("body").cast("string")).alias("body"), "error"))
    bodies = downloads.get(found.select(F.col("text_url").alias("url"))).withColumnRenamed("url", "text_url")
    rows = found.join(bodies, "text_url", "left").withColumn("name", F.concat_ws("_", "id", F.concat(safe_filename(F.col("title"), 50), F.lit(".txt"))))
    download.write_files(rows, f"{raw}/gutenberg")
    reference = F.concat(F.lit(base.rstrip("/") + "/"), F.col("id").cast("string"), F.lit("/"))
    files.write_sidecar(found.select("id", "title", "authors", reference.alias("reference")), "id", f"{raw}/gutenberg")
    return rows.select("id", "title", F.when(F.col("body").isNotNull(), F.col("name")).alias("name"), F.coalesce("error", F.when(F.col("text_url").isNull(), "no plain text")).alias("error"))


def fetch_archive(spark: SparkSession, urls: list[str], raw: str, fetcher=None, pause: float = ARCHIVE_PAUSE) -> DataFrame:
    """Writes the files of archive items under ``raw``/loc: an item's PDF, else its first image, and its transcription; of an
    exhibit page its text. Writes the sidecar of their metadata, which this returns; what fails leaves a stub titled by its
    id. What was fetched is kept, as for books."""
    downloads = Downloads(spark, f"{raw}/_downloads", fetcher, pause)
    asked = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "place int, url string").withColumn("kind", url_type(F.col("url")))
    text = lambda body: F.make_valid_utf8(body.cast("string"))
    named = lambda c, end: F.concat(F.col("id"), F.lit("_"), safe_filename(or_else(F.col("title"), F.col("id")), 40), end).alias(c)

    api_url = F.concat(F.rtrim("url", F.lit("/")), F.lit("/?fo=json"))
    items = asked.filter("kind <> 'exhibits'").withColumn("api", api_url)
    replies = items.join(downloads.get(items.select(F.col("api").alias("url"))).withColumnRenamed("url", "api"), "api")
    parsed = api.items_of(replies.select("url", text(F.col("body")).alias("body"), "error"))
    binary = F.coalesce("pdf_url", F.get("image_urls", F.lit(0)))
    ending = F.when(F.col("pdf_url").isNotNull(), ".pdf").otherwise(image_extension(binary))
    wanted = parsed.select("*", F.array(F.struct(F.lit(0).alias("n"), binary.alias("source"), named("name", ending)), F.struct(F.lit(1).alias("n"), F.col("fulltext_url").alias("source"), named("name", F.lit(".txt")))).alias("parts"))
    parts = wanted.select("url", F.explode("parts").alias("p")).select("url", "p.*").filter(F.col("source").isNotNull())
    got = parts.join(downloads.get(parts.select(F.col("source").alias("url"))).withColumnRenamed("url", "source"), "source").filter(F.col("body").isNotNull())
    readable = F.encode(html.fulltext(F.col("source"), text(F.when(F.col("n") == 1, F.col("body")))), "UTF-8")
    item_files = got.select("url", "n", "name", F.when(F.col("n") == 1, readable).otherwise(F.col("body")).alias("body")).filter(F.octet_length("body") > 0)

    pages = asked.filter("kind = 'exhibits'")
    pages = pages.join(downloads.get(pages.select("url")), "url").withColumn("id", archive_id(F.col("url"))).withColumn("p", html.page_text(text(F.col("body"))))
    pages = pages.withColumn("title", F.when(F.col("body").isNotNull(), F.col("p.title")))
    page_files = pages.filter(F.col("body").isNotNull()).select("url", F.lit(0).alias("n"), named("name", F.lit(".txt")), F.encode("p.content", "UTF-8").alias("body"))

    # written once: names go to the sidecar, bodies to files
    folder = new_folder(spark, "fetched")
    item_files.unionByName(page_files).write.parquet(folder)
    written = spark.read.parquet(folder)
    download.write_files(written, f"{raw}/loc")
    lists = written.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("files"))
    null = F.lit(None).cast("string")
    exhibits = pages.select(
        "url", "id", or_else(F.col("title"), F.col("id")).alias("title"), F.when(F.col("body").isNotNull(), "Speech").otherwise("Document").alias("document_type"),
        null.alias("date"), null.alias("place"), null.alias("from"), null.alias("to"),
    )
    meta = parsed.select("url", "id", "title", "document_type", "date", "place", "from", "to").unionByName(exhibits)
    meta = meta.join(asked.select("url", "place", F.col("kind").alias("url_type")).withColumnRenamed("place", "_order"), "url").join(lists, "url", "left")
    columns = ["id", F.coalesce("files", F.array().cast("array<string>")).alias("files"), "url", "url_type", "title", "document_type", "date", "place", "from", "to"]
    sidecar = new_folder(spark, "sidecar")
    meta.select(F.format_string("%09d", "_order").alias("_key"), *columns).write.parquet(sidecar)
    meta = spark.read.parquet(sidecar)
    rows = meta.select(F.col("_key").alias("key"), F.to_json(F.struct(*[c for c in meta.columns if c != "_key"]), {"ignoreNullFields": "false"}).alias("json"))
    files.write_document([(None, rows)], f"{raw}/loc", "_metadata.json")
    return meta.orderBy("_key").drop("_key")


def build_dataset(spark: SparkSession, raw: str, processed: str, books: bool = True, archive: bool = True) -> None:
    """Cleans raw books and archive texts into one data set each."""
    if books:
        meta = files.read_metadata(spark, f"{raw}/gutenberg/_metadata.json", BOOK_META)
        rows = documents.book_documents(meta, files.read_texts(spark, f"{raw}/gutenberg/*.txt"))
        files.write_rows(rows, f"{processed}/books")
    if archive:
        meta = files.read_metadata(spark, f"{raw}/loc/_metadata.json", ARCHIVE_META)
        files.write_rows(documents.archive_documents(meta, files.read_texts(spark, f"{raw}/loc/*.txt")), f"{processed}/archive")


def combine_dataset(spark: SparkSession, processed: str) -> DataFrame:
    """Both data sets, books first; a missing one has no rows."""
    sets = [files.read_rows(spark, f"{processed}/{name}", DOCUMENT) for name in ("books", "archive")]
    return documents.combine(*sets)


def _inputs(docs: DataFrame) -> DataFrame:
    author = documents.author_of(F.col("from"), F.col("document_type"))
    return docs.select("id", "title", "document_type", author.alias("author"), "content")


def _completer(model: models.Completer, retry: models.Retry, ledger: ReplyLedger | None):
    return ledger.completer(model, type(model).__name__, retry) if ledger else models.complete_with(model, retry)


def batched_pipeline(spark: SparkSession, docs: DataFrame, model: models.Completer, ledger: ReplyLedger | None = None) -> DataFrame:
    """Extraction records: books by batches, other documents directly. With a ledger no prompt is paid for twice."""
    small_batches(spark)
    big, small = documents.route(_inputs(docs), F.col("document_type") == "Book")
    complete = _completer(model, models.Retry(), ledger)
    return extraction.batched(big, events(spark), complete).unionByName(extraction.direct(small, complete))


def hybrid_pipeline(
    spark: SparkSession, docs: DataFrame, model: models.Completer, embedder: models.Embedder, index_path: str | None = None, ledger: ReplyLedger | None = None
) -> DataFrame:
    """Extraction records: books by retrieval of passages for each event, other documents directly.

    Unknown senders, titles and types get this job's own defaults (``documents.for_hybrid``)."""
    small_batches(spark)
    big, small = documents.route(documents.for_hybrid(docs), F.col("document_type") == "Book")
    complete = _completer(model, models.Retry(everything=True), ledger)
    key = ("id", "chunk_id")
    folder = index_path or new_folder(spark, "hybrid")
    # chunks, their vectors and those of the few event queries are written once, so each text is embedded once
    vectors = files.load_vectors(spark, f"{folder}/vectors")
    index = files.load_index(spark, folder, key)
    if vectors is None or index is None:
        chunking.chunk_documents(big, doc_id="id").write.mode("overwrite").parquet(f"{folder}/chunks")
        chunks = spark.read.parquet(f"{folder}/chunks")
        files.save_index(retrieval.keyword_index(chunks, key), folder)
        files.save_vectors(chunks.select(*key, models.embed_with(embedder, F.col("text")).alias("embedding")), f"{folder}/vectors", key)
        index, vectors = files.load_index(spark, folder, key), files.load_vectors(spark, f"{folder}/vectors")
    chunks = spark.read.parquet(f"{folder}/chunks")
    dimension = events(spark).select("event", event_query(F.col("event")).alias("query"))
    queries = new_folder(spark, "queries")
    dimension.withColumn("embedding", models.embed_with(embedder, F.col("query"))).write.parquet(queries)
    pairs = extraction.with_events(big.drop("content"), dimension.select("event"))
    # one batch of queries: every event in every book
    asked = pairs.select("event", F.concat_ws("\x1f", "id", "event").alias("query_id"), F.col("id").alias("book")).join(F.broadcast(spark.read.parquet(queries)), "event")
    hits = retrieval.hybrid_search(index, vectors, asked, only=("book", "id"), filter_first=True).join(chunks.select(*key, "text"), list(key))
    found = hits.select("id", F.split_part("query_id", F.lit("\x1f"), F.lit(2)).alias("event"), "rank", "text")
    return extraction.retrieved(pairs, found, complete).unionByName(extraction.direct(small, complete))


def run_extraction(spark: SparkSession, processed: str, out: str, model: models.Completer, embedder: models.Embedder | None = None, books_only: bool = False) -> None:
    """Extraction over the combined data set with its sinks: records by document and event, and the
    run's envelopes. With an embedder books go by retrieval (its index is kept under ``out``), else by batches."""
    docs = combine_dataset(spark, processed)
    docs = docs.filter("document_type = 'Book'") if books_only else docs
    ledger = ReplyLedger(spark, f"{out}/replies")
    records = hybrid_pipeline(spark, docs, model, embedder, f"{out}/index", ledger) if embedder else batched_pipeline(spark, docs, model, ledger)
    # every sink reads the same records
    records.write.mode("overwrite").parquet(f"{out}/records")
    records = spark.read.parquet(f"{out}/records")
    files.write_events(records, f"{out}/events")
    loc, books = records.filter(~F.startswith("document_id", F.lit("gutenberg_"))), records.filter(F.startswith("document_id", F.lit("gutenberg_")))
    files.write_envelopes(spark, loc, books, files.run_metadata(type(model).__name__, loc=loc, gutenberg=books), f"{out}/runs")


def evaluate(
    spark: SparkSession, records: DataFrame, model: models.Completer, runs: int = 1, temperature: float | None = None, ledger: ReplyLedger | None = None
) -> DataFrame:
    """Judge scores of every pair, strategy and run at a temperature. ``records`` carry doc_ord and source.
    With a ledger each run of a pair is a call of its own, and none is made twice."""
    dimension = events(spark)
    primary = claims.primary_claims(records.filter("source = 'loc'"), dimension)
    authors = claims.author_claims(records.filter("source = 'gutenberg'"), dimension)
    work = evaluation.work_plan(claims.comparison_pairs(primary, authors), spark, runs)
    complete = ledger.completer(model, type(model).__name__, models.Retry(tries=1), temperature=temperature, apart=("run",)) if ledger else None
    return models.judge(work, model, temperature=temperature, complete=complete)


# How the two evaluations ask, by runs of a pair and temperature.
SELF_CONSISTENCY, INTER_RATER = {"runs": 5, "temperature": 0.5}, {"runs": 1, "temperature": 0.0}


def self_consistency(spark: SparkSession, records: DataFrame, model: models.Completer, ledger: ReplyLedger | None = None) -> DataFrame:
    """Statistics over five runs of each pair and strategy at a temperature of 0.5."""
    return evaluation.self_consistency(evaluate(spark, records, model, ledger=ledger, **SELF_CONSISTENCY))


def inter_rater(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Agreement of human labels (event, author, rating) with each strategy's scores."""
    rated = labels.join(scores.select("event", "author", "prompt_type", "score"), ["event", "author"])
    return agreement.agreement(
        rated.withColumn("human", agreement.consistent(F.col("rating"))).withColumn("judge", agreement.reaches(F.col("score"))), ["prompt_type"]
    )
