"""Reading data sets, raw texts, metadata and index tables; writing results."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.links import event_slug
from ..functions.vectors import normalize
from ..shared import new_folder
from .committed import CommittedTable


def _schema(schema):
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may have wildcards, matches anything in whatever store it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON array of records, whole files at a time; the schema is declared, never inferred."""
    return spark.read.schema(_schema(schema)).json(path, multiLine=True)


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame:
    """``read_array``, or no rows where there is no such file."""
    return read_array(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], _schema(schema))


def read_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_rows`` has written under ``path``: JSON lines; no rows where there is nothing."""
    if not exists(spark, f"{path}/*.json"):
        return spark.createDataFrame([], _schema(schema))
    return spark.read.schema(_schema(schema)).json(path)


def read_metadata(spark: SparkSession, path: str, schema) -> DataFrame:
    """A small JSON array whose file name begins with ``_``, which Spark's file sources pass over;
    no rows where there is no such file. The file is read by the driver."""
    if not exists(spark, path):
        return spark.createDataFrame([], _schema(schema))
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.createDataFrame([(text,)], "j string").select(F.inline(F.from_json("j", T.ArrayType(_schema(schema)))))


def read_records(spark: SparkSession, folder: str, schema, without: Iterable[str] = ()) -> DataFrame:
    """One-record JSON files of a folder with their ``file_name``, in order of it; named files are left out."""
    rows = spark.read.schema(_schema(schema)).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    named = rows.withColumn("file_name", F.col("_metadata.file_name"))
    return named.filter(~F.col("file_name").isin(*without) if (without := list(without)) else F.lit(True)).orderBy("file_name")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of files by name; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/", -1), -1).alias("name"), "length").orderBy("name")


def read_labels(spark: SparkSession, path: str, schema) -> DataFrame:
    """Annotations of a label file that holds them under ``annotations``."""
    wrapped = T.StructType().add("annotations", T.ArrayType(_schema(schema)))
    return spark.read.schema(wrapped).json(path, multiLine=True).select(F.inline("annotations"))


def read_template(path: str) -> str:
    """A prompt template from the driver's disk."""
    with open(path, encoding="utf-8") as f:
        return f.read().strip()


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines, overwritten."""
    df.write.mode("overwrite").json(path)


def write_array(df: DataFrame, path: str) -> None:
    """One pretty JSON array on the driver's disk, for results meant to be read by people.

    Rows arrive one partition at a time and are written as they come; nothing is held whole.
    """
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            text = json.dumps(json.loads(row["j"]), indent=2, ensure_ascii=False)
            f.write(("," if i else "") + "\n  " + text.replace("\n", "\n  "))
        f.write("\n]\n")


def write_events(records: DataFrame, path: str) -> None:
    """Event records by document and event; only the partitions written are replaced."""
    rows = records.withColumn("event_slug", event_slug(F.col("event")))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id", "event_slug")
    writer.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_document(sections: list[tuple[str | None, DataFrame | str]], path: str, name: str = "document.json") -> None:
    """One JSON object as the file ``name`` under ``path``, from any number of rows. (One section without a name
    makes the document an array.)

    ``sections`` are its members in order: a name with a JSON text, or with rows (key, json) that become an array in
    order of their keys. Tasks write the rows, commas included, as files that follow each other; the file system
    appends them to each other when all are there. No task and no driver holds more than a row or a buffer.
    """
    spark = next(v for _, v in sections if isinstance(v, DataFrame)).sparkSession
    folder = new_folder(spark, "document")
    # numbered and written once, so that the first row of an array is the same one for all
    for i, (_, rows) in enumerate(sections):
        if isinstance(rows, DataFrame):
            rows.select("key", "json", F.monotonically_increasing_id().alias("n")).write.parquet(f"{folder}/{i}")
    lines, fixed = [], []
    for i, (member, value) in enumerate(sections):
        head = "" if member is None else ("{" if i == 0 else ",") + json.dumps(member) + ":"
        if isinstance(value, str):
            fixed.append((i, 0, head + value))
            continue
        fixed.append((i, 0, head + "["))
        fixed.append((i, 2, "]"))
        rows = spark.read.schema("key string, json string, n long").parquet(f"{folder}/{i}")
        order = F.struct("key", "n")
        first = rows.agg(F.min(order).alias("first"))
        text = F.concat(F.when(order == F.col("first"), "").otherwise(","), F.col("json"))
        lines.append(rows.crossJoin(F.broadcast(first)).select(F.lit(i).alias("section"), F.lit(1).alias("part"), "key", "n", text.alias("text")))
    if sections[0][0] is not None:
        fixed.append((len(sections), 0, "}"))
    every = spark.createDataFrame(fixed, "section int, part int, text string").select("section", "part", F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("n"), "text")
    for rows in lines:
        every = every.unionByName(rows)
    order = ["section", "part", "key", "n"]
    # a space and not a line end between rows: the document is one line
    every.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.option("lineSep", " ").text(f"{folder}/text")
    _join_files(spark, f"{folder}/text", f"{path}/{name}")


def _join_files(spark: SparkSession, folder: str, path: str) -> None:
    """The files that Spark has written to a folder, in order, as one file that is put in place whole."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(folder), hadoop.fs.Path(path)
    there, here = source.getFileSystem(conf), target.getFileSystem(conf)
    parts = sorted((s.getPath().toString() for s in there.listStatus(source)), key=lambda p: p.rsplit("/", 1)[-1])
    draft = hadoop.fs.Path(target.getParent(), f".{target.getName()}.draft")
    out = here.create(draft, True)
    for p in parts:
        if "/part-" in p:
            stream = there.open(hadoop.fs.Path(p))
            hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
    out.close()
    here.delete(target, False)
    here.rename(draft, target)


def write_envelopes(spark: SparkSession, loc: DataFrame, books: DataFrame, metadata: dict, path: str) -> None:
    """The run as three envelopes (all, archive, books), each one JSON object in its folder."""

    def documents(rows: DataFrame) -> DataFrame:
        e = F.struct("event", "author", "claims", "temporal_details", "tone")
        docs = rows.groupBy("document_id", "document_title", "document_type").agg(F.sort_array(F.collect_list(e)).alias("extractions"))
        return docs.select(F.col("document_id").alias("key"), F.to_json(F.struct("document_id", "document_title", "document_type", "extractions")).alias("json"))

    head = ("metadata", json.dumps(metadata))
    a, b = ("loc_extractions", documents(loc)), ("gutenberg_extractions", documents(books))
    for folder, sections in (("all", [head, a, b]), ("loc", [head, a]), ("gutenberg", [head, b])):
        write_document(sections, f"{path}/{folder}")


def write_sidecar(rows: DataFrame, key: str, folder: str) -> None:
    """Rows as the JSON array ``_metadata.json`` beside raw files, in order of ``key``; ``read_metadata`` reads it."""
    write_document([(None, rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")))], folder, "_metadata.json")


def run_metadata(model: str, **counted: DataFrame) -> dict:
    """What an envelope says of its run: when, by which model, for which events, and how many
    documents each side had (``loc_documents_processed`` and so on)."""
    from datetime import datetime, timezone

    from ..schemas import EVENTS

    counts = {f"{side}_documents_processed": rows.select("document_id").distinct().count() for side, rows in counted.items()}
    return {"extraction_timestamp": datetime.now(timezone.utc).isoformat(timespec="seconds"), "target_events": EVENTS, "model_used": model, **counts}


def write_nested(scores: DataFrame, path: str, strategies: list[str]) -> None:
    """Judge scores as one JSON object a line for each (event, author), with an object for each
    strategy that holds its score and reasoning."""
    one = lambda s: F.any_value(F.when(F.col("prompt_type") == s, F.struct("score", "contradictions", "reasoning")), ignoreNulls=True).alias(s)
    nested = scores.groupBy("event", "author").agg(F.struct(*[one(s) for s in strategies]).alias("results"))
    nested.write.mode("overwrite").json(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows whose keys are not in the table yet; the table may be missing. For one writer at a
    time; ``append_committed`` is for several."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def append_committed(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends rows whose keys are not in the committed table of ``path`` yet, and returns how many; the table
    may be missing. Several writers may append at once: no key gets in twice."""
    return CommittedTable(rows.sparkSession, path, rows.schema).append(rows, keys)


def read_committed(spark: SparkSession, path: str, schema) -> DataFrame:
    return CommittedTable(spark, path, schema).read()


def save_index(index, path: str) -> None:
    """A keyword index as Parquet tables."""
    index.postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.average_length.write.mode("overwrite").parquet(f"{path}/length")


def load_index(spark: SparkSession, path: str, key: tuple[str, ...]):
    """The saved index, or None if a table of it is missing."""
    from ..operators.retrieval import KeywordIndex

    parts = [f"{path}/{p}" for p in ("postings", "terms", "length")]
    if not all(exists(spark, f"{p}/_SUCCESS") for p in parts):
        return None
    return KeywordIndex(*(spark.read.parquet(p) for p in parts), key)


def save_vectors(vectors: DataFrame, path: str, key: tuple[str, ...], append: bool = False) -> None:
    """A vector index as a committed table (key, embedding of length one); null vectors are left out.
    ``append`` adds to it; a key that is there already is then not written again."""
    rows = vectors.filter(F.col("embedding").isNotNull()).select(*key, normalize(F.col("embedding")).alias("embedding"))
    table = CommittedTable(vectors.sparkSession, path, rows.schema)
    if append:
        table.append(rows, list(key))
        return
    part = table.write_part(rows)
    while not table.commit(table.snapshot(), [part]):
        pass


def load_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved vectors, or None."""
    found = CommittedTable(spark, path, T.StructType()).snapshot()
    if not found.parts:
        return None
    return spark.read.parquet(*(f"{path}/{p['folder']}" for p in found.parts))


def load_or_build(spark: SparkSession, path: str, key: tuple[str, ...], units: DataFrame, text: str = "text"):
    from ..operators.retrieval import keyword_index

    found = load_index(spark, path, key)
    if found is None:
        save_index(keyword_index(units, key, text), path)
        found = load_index(spark, path, key)
    return found
