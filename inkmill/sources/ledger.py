"""A ledger of model replies: each prompt is paid for once.

Replies are rows of a committed table, keyed by a hash of prompt, model, temperature and what else tells
calls apart (a run number, where one prompt is to be asked several times). A plan's prompts are joined with
it, only the rest are asked, in waves, and each wave is committed before the next one begins. A job that is
killed loses the calls of one wave at most, and a task that is tried again those of its share of one;
every later job finds the rest paid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import Completer, Retry, complete_with
from ..shared import new_folder
from .committed import CommittedTable

REPLY_ROW = "key string, model string, temperature double, prompt string, reply string, error string"


class ReplyLedger:
    """Replies under ``path``. ``wave`` prompts are asked between two commits, spread over ``slots`` tasks."""

    def __init__(self, spark: SparkSession, path: str, wave: int = 1000, slots: int | None = None):
        self.spark, self.wave, self.slots = spark, wave, slots
        self.table = CommittedTable(spark, path, REPLY_ROW)

    @staticmethod
    def key(prompt: Column, model: str, temperature: float | None, apart: list[Column]) -> Column:
        parts = [F.lit(model), F.lit("" if temperature is None else repr(float(temperature))), *[F.coalesce(c.cast("string"), F.lit("")) for c in apart]]
        # lengths, so that no two lists of parts read alike
        return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts], prompt), 256)

    def known(self) -> DataFrame:
        """Good replies, one for each key. (Failed calls are kept for the record and asked again.)"""
        return self.table.read().filter(F.col("error").isNull()).groupBy("key").agg(F.min("reply").alias("reply"))

    def completer(
        self, model: Completer, name: str, retry: Retry | None = None, want_json: bool = True, temperature: float | None = None, apart: tuple[str, ...] = ()
    ) -> Callable[[DataFrame], DataFrame]:
        """As ``models.complete_with``: a function that adds ``reply`` and ``error`` to rows with a ``prompt``.

        ``name`` stands for the model in keys. ``apart`` names columns by which equal prompts are different
        calls. Calls are made when the function is applied; rows with a null prompt are not asked."""
        ask = complete_with(model, retry, want_json, self.slots, temperature)

        def run(rows: DataFrame) -> DataFrame:
            key = self.key(F.col("prompt"), name, temperature, [F.col(c) for c in apart])
            # written once: a prompt column may come from calls itself
            folder = new_folder(self.spark, "asked")
            rows.withColumn("_key", F.when(F.col("prompt").isNotNull(), key)).write.parquet(folder)
            asked = self.spark.read.parquet(folder)
            wanted = asked.filter(F.col("_key").isNotNull()).select(F.col("_key").alias("key"), "prompt").dropDuplicates(["key"])
            rest = wanted.join(self.known().select("key"), "key", "left_anti")
            n = rest.count()
            waves = -(-n // self.wave)
            failed = self.spark.createDataFrame([], "key string, error string")
            if n:
                place = F.pmod(F.xxhash64("key"), F.lit(waves))
                pending = new_folder(self.spark, "pending")
                rest.withColumn("wave", place.cast("int")).write.partitionBy("wave").parquet(pending)
                tried = [p for p in (self._wave(ask, pending, w, name, temperature) for w in range(waves)) if p]
                failed = self.table._read(tried).filter(F.col("error").isNotNull()).select("key", "error")
            out = asked.join(self.known().withColumnRenamed("key", "_key"), "_key", "left").join(failed.withColumnRenamed("key", "_key"), "_key", "left")
            # another writer may have had a reply where this one failed
            return out.select(*rows.columns, "reply", F.when(F.col("reply").isNull(), F.col("error")).alias("error"))

        return run

    def _wave(self, ask, pending: str, wave: int, name: str, temperature: float | None) -> dict | None:
        """Asks a wave's prompts that are still open and commits the replies."""
        prompts = self.spark.read.schema("key string, prompt string").parquet(f"{pending}/wave={wave}") if wave in self._waves(pending) else None
        if prompts is None:
            return None
        open_ = prompts.join(self.known().select("key"), "key", "left_anti")
        replied = ask(open_).select("key", F.lit(name).alias("model"), F.lit(temperature).cast("double").alias("temperature"), "prompt", "reply", "error")
        part = self.table.write_part(replied)
        if not part["rows"]:
            return None
        while True:
            base = self.table.snapshot()
            if self.table.commit(base, [*base.parts, part]):
                return part

    def _waves(self, pending: str) -> set[int]:
        return {int(n.removeprefix("wave=")) for n in self.table.store.names(pending) if n.startswith("wave=")}

    def calls(self) -> DataFrame:
        """(model, temperature, calls, failed): what has been asked so far."""
        return self.table.read().groupBy("model", "temperature").agg(F.count("*").alias("calls"), F.count("error").alias("failed"))
