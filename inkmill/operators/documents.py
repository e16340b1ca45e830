"""From raw texts and metadata to one set of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.header import parse_header
from ..functions.links import archive_id, url_type
from ..functions.names import normalize_name
from ..functions.text import fix_encoding, normalize_field, or_else
from ..shared import new_folder


def first_match(left: DataFrame, right: DataFrame, on: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``left`` with the first match of ``right``, rows without one)."""
    rank = F.row_number().over(Window.partitionBy(on).orderBy(order))
    firsts = right.withColumn("_r", rank).filter("_r = 1").drop("_r")
    return left.join(firsts, on), left.join(right.select(on).distinct(), on, "left_anti")


def book_documents(meta: DataFrame, texts: DataFrame) -> DataFrame:
    """Books from metadata (id, title, authors) and whole texts (path, value).

    A text belongs to the id that its file name begins with; the first file by path counts, and
    books without one are left out.
    """
    named = texts.withColumn("id", F.regexp_extract("path", r"(\d+)_[^/]*\.txt\z", 1).try_cast("int"))
    joined, _ = first_match(meta.select("id", "title", "authors"), named, "id", "path")
    null = F.lit(None).cast("string")
    return joined.select(
        F.concat(F.lit("gutenberg_"), F.col("id")).alias("id"),
        normalize_field(F.col("title")).alias("title"),
        F.col("path").alias("reference"),
        F.lit("Book").alias("document_type"),
        null.alias("date"),
        null.alias("place"),
        normalize_name(F.col("authors")).alias("from"),
        null.alias("to"),
        fix_encoding(F.col("value")).alias("content"),
    )


def archive_documents(meta: DataFrame, texts: DataFrame) -> DataFrame:
    """Archive documents from metadata (with the list ``files``) and whole texts (path, value).

    The first text file of the list counts; items without one are left out. Fields found in the
    text's header come before those of the metadata.
    """
    name = lambda c: F.element_at(F.split(c, "/", -1), -1)
    file = F.get(F.filter("files", lambda f: F.endswith(f, F.lit(".txt"))), F.lit(0))
    # of texts with one name in several folders the first by path counts
    joined, _ = first_match(meta.withColumn("_file", name(file)), texts.withColumn("_file", name(F.col("path"))), "_file", "path")
    h = joined.withColumn("_h", parse_header(F.col("value")))
    pick = lambda f: or_else(F.col(f"_h.{f}"), F.col(f"`{f}`"))
    return h.select(
        F.concat(F.lit("loc_"), F.col("id")).alias("id"),
        normalize_field(pick("title")).alias("title"),
        F.col("path").alias("reference"),
        pick("document_type").alias("document_type"),
        pick("date").alias("date"),
        normalize_field(pick("place")).alias("place"),
        normalize_name(pick("from")).alias("from"),
        normalize_name(pick("to")).alias("to"),
        fix_encoding(F.col("value")).alias("content"),
    )


def with_source(docs: DataFrame) -> DataFrame:
    """Adds the source that the id's prefix names; null for others."""
    return docs.withColumn("source", F.when(F.startswith("id", F.lit("gutenberg_")), "gutenberg").when(F.startswith("id", F.lit("loc_")), "loc"))


def combine(*sets: DataFrame) -> DataFrame:
    out, *rest = sets
    for other in rest:
        out = out.unionByName(other, allowMissingColumns=True)
    return with_source(out)


def with_stub(requests: DataFrame, replies: DataFrame, on: str) -> DataFrame:
    """Requests with their replies; one without a reply becomes a ``Document`` titled by its id."""
    joined = requests.join(replies, on, "left")
    return joined.withColumn("title", or_else(F.col("title"), F.col(on))).withColumn("document_type", or_else(F.col("document_type"), F.lit("Document")))


def with_link_parts(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.withColumn("url_type", url_type(F.col(url))).withColumn("id", archive_id(F.col(url)))


def author_of(sender: Column, document_type: Column) -> Column:
    """Who a document is by: its sender, else its type."""
    return F.coalesce(sender, document_type)


# What the retrieval job takes for unknown authors, of books and of other documents.
UNKNOWN_AUTHOR, LETTER_AUTHOR = "Unknown Author", "Abraham Lincoln"


def for_hybrid(docs: DataFrame) -> DataFrame:
    """id, title, document_type, author and content with the retrieval job's defaults: a document without
    a type is a letter; books without a sender are by an unknown author, other documents by Lincoln."""
    kind = F.coalesce("document_type", F.lit("Letter"))
    author = F.coalesce("from", F.when(kind == "Book", UNKNOWN_AUTHOR).otherwise(LETTER_AUTHOR))
    return docs.select("id", F.coalesce("title", F.lit("Unknown")).alias("title"), kind.alias("document_type"), author.alias("author"), "content")


def with_default_id(docs: DataFrame, prefix: str, order: str) -> DataFrame:
    """Rows without an id get ``prefix`` and their number, from 0 in order of ``order``.

    Numbers come from counts per range of ``order``, not from one sorted task. The ranges are written
    once, so that rows and counts speak of the same ones.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    missing = docs.filter(F.col("id").isNull())
    # by the whole row, too: else rows with one value of ``order`` would be one range
    ties = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    ranged = missing.repartitionByRange(parts, F.col(order), ties).withColumn("_p", F.spark_partition_id())
    folder = new_folder(spark, "ids")
    ranged.write.parquet(folder)
    ranged = spark.read.schema(ranged.schema).parquet(folder)
    numbered = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    # one row for each range
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    named = numbered.join(F.broadcast(before), "_p").withColumn("id", F.concat(F.lit(prefix), F.col("_b") + F.col("_i") - 1))
    return docs.filter(F.col("id").isNotNull()).unionByName(named.select(*docs.columns))


def files_per_item(items: DataFrame, files: str = "files") -> DataFrame:
    """Adds the number of files of each item; none counts as 0."""
    return items.withColumn("n_files", F.coalesce(F.size(files), F.lit(0)))


def report(docs: DataFrame, by: str, content: str = "content") -> DataFrame:
    """Entries, characters and average characters (whole numbers) of each group."""
    return docs.groupBy(by).agg(
        F.count("*").alias("entries"),
        F.sum(F.length(content)).alias("chars"),
        F.floor(F.sum(F.length(content)) / F.count("*")).alias("average_chars"),
    )


def cleaning_delta(docs: DataFrame, raw: str, clean: str) -> DataFrame:
    return docs.withColumn("removed_chars", F.length(raw) - F.length(clean))


def route(docs: DataFrame, is_book: Column) -> tuple[DataFrame, DataFrame]:
    """(documents for the batched path, documents for the direct path)."""
    book = F.coalesce(is_book, F.lit(False))
    return docs.filter(book), docs.filter(~book)
