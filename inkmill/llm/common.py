"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import BATCH_BYTES, new_folder, release, small_batches  # noqa: F401

_OPEN: list[Scratch] = []


class Scratch:
    """Tables written to the shared folder to cut lineage or to be scanned again.

    ``keep`` writes a frame as Parquet and reads it back; ``drop`` deletes tables that no
    returned plan refers to any more. What a returned plan still reads stays until ``close_all``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_folder(spark, name)
        self._n = 0
        self._kept: list[DataFrame] = []
        _OPEN.append(self)

    def path(self, label: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{label}"

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._inkmill_path = path
        self._kept.append(out)
        return out

    def _delete(self, *paths: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)

    def drop(self, *frames: DataFrame) -> None:
        self._delete(*(df._inkmill_path for df in frames))
        self._kept = [df for df in self._kept if all(df is not x for x in frames)]

    def drop_but(self, *frames: DataFrame) -> None:
        """Deletes all tables kept so far but ``frames``."""
        self.drop(*(df for df in self._kept if all(df is not x for x in frames)))

    def close(self) -> None:
        self._delete(self.root)
        self._kept = []


def close_all() -> None:
    """Deletes every scratch table of the operators; to be called once their results are written."""
    while _OPEN:
        _OPEN.pop().close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """(frame, columns): ``used`` columns under their names and all others in one struct, so that
    columns an operator adds cannot clash with any of theirs; and the columns to select at the end."""
    others = [c for c in docs.columns if c not in used]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    back = [F.col(c) if c in used else F.col(f"_others.`{c}`").alias(c) for c in docs.columns]
    return docs.select(*used, packed.alias("_others")), back


#: A-Z to a-z only; ``lower`` would also change other alphabets.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b): the least node each can reach.

    Alternating large-star and small-star passes. A pass is an aggregation with map-side
    combine and a join back, so a node with very many links is split by Spark's skew join;
    nothing but two numbers reaches the driver. Each pass is written to the shared folder.
    """

    def least(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))

    def mark(df: DataFrame):
        # count plus an order-free digest: equal marks mean an unchanged edge set
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = scratch.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.keep(
            both.filter("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(),
            "large",
        )
        low = least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.keep(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small")
        scratch.drop(e, large)
        e, after = nxt, mark(nxt)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
