"""Exact quantiles by repeated histograms: no group's values meet in one task, and nothing is sorted.

A quantile of n values lies between the values of two ranks. Each rank starts with its group's whole range.
A pass counts the values of every open range in ``BINS`` bins of equal width, with the least and the greatest
of each bin (summed up where the rows lie), and keeps the bin that holds the rank; a range of one value is
closed. A pass shrinks a range to a 4096th at least, so few are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import new_folder

BINS = 4096
#: Up to so many open ranges (of two numbers and a group's name) are broadcast.
BROADCAST_RANGES = 100_000


def exact_quantiles(values: DataFrame, by: str, column: str, probabilities: dict[str, float]) -> DataFrame:
    """(by, a column for each name of ``probabilities``): quantiles with linear interpolation.

    Null, NaN and infinite values take no part; a group without others has no row. A null group is a group."""
    spark = values.sparkSession
    folder = new_folder(spark, "quantiles")
    number = F.col(column).cast("double")
    rows = values.select(F.col(by).alias("g"), number.alias("x")).filter(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")))
    rows.write.parquet(f"{folder}/values")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/values")
    ends = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for name, p in probabilities.items()])
    targets = ends.select("g", "lo", "hi", F.explode(places).alias("t")).select("g", "lo", "hi", "t.name", "t.at", F.explode(F.array(F.floor("t.at"), F.ceil("t.at"))).alias("rank"))
    # ``rank`` is the place within the range, ``whole`` the place within the group
    state = targets.select("g", "name", "at", F.col("rank").alias("whole"), "rank", "lo", "hi").distinct()
    done = 0
    while True:
        path = f"{folder}/{done:03d}"
        state.write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        open_ = state.filter("lo < hi")
        n = open_.count()
        if not n:
            break
        ranges = open_.select(F.col("g").alias("of"), "lo", "hi").distinct()
        ranges = F.broadcast(ranges) if n <= BROADCAST_RANGES else ranges
        inside = rows.join(ranges, F.col("g").eqNullSafe(F.col("of")) & F.col("x").between(F.col("lo"), F.col("hi")))
        # halves, since the width of a range may be beyond the largest number
        place = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counted = inside.withColumn("bin", F.least(F.floor(place * BINS), F.lit(BINS - 1))).groupBy("of", "lo", "hi", "bin").agg(
            F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most")
        )
        before = F.sum("c").over(Window.partitionBy("of", "lo", "hi").orderBy("bin")) - F.col("c")
        counted = counted.withColumn("before", before).withColumnsRenamed({"lo": "from", "hi": "to"})
        same = F.col("g").eqNullSafe(F.col("of")) & (F.col("lo") == F.col("from")) & (F.col("hi") == F.col("to"))
        holds = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))
        found = open_.join(counted, same).filter(holds).select("g", "name", "at", "whole", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))
        state = state.filter("lo = hi").unionByName(found)
        done += 1
    value = lambda f: F.max(F.when(F.col("whole") == f("at"), F.col("lo")))
    low, high = value(F.floor), value(F.ceil)
    one = state.groupBy("g", "name").agg((low + (F.max("at") - F.floor(F.max("at"))) * (high - low)).alias("v"))
    wide = one.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in probabilities])
    return wide.withColumnRenamed("g", by)
