"""Incremental extraction: new documents are worked on as they arrive.

A file source feeds micro-batches; each batch's records replace the partitions of its documents,
so a batch that runs again after a failure writes the same result. The checkpoint keeps what was
read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def documents_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1000, file_format: str = "parquet") -> DataFrame:
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(folder)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each ``keys`` in a stream, over all its micro-batches. Keys are state: one is forgotten when
    the watermark, ``delay`` behind the latest ``time``, has passed its first row by ``delay``; rows later than that are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def extract_incrementally(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str] | None = None, partition_by: list[str] | None = None
):
    """Runs over what has arrived and stops. ``work`` is a batch function; of rows with equal ``keys``
    within a batch one is kept, without ``keys`` all are; with ``partition_by`` a batch replaces its partitions, else it is
    written to a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        rows = work(batch.dropDuplicates(keys) if keys else batch)
        if partition_by:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(out)
        else:
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
