"""Statistics of judge scores, in long form: one row for each (event, author, prompt_type[, run])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import new_folder
from .quantiles import BROADCAST_RANGES, exact_quantiles

# Prompt strategies in order, the score from which a pair counts as consistent, and score bands.
STRATEGIES = ["zero_shot", "chain_of_thought", "few_shot"]
THRESHOLD = 70
SCORE_BANDS, STD_BANDS, RANGE_LIMIT, SEVERE_RANGE = (90, 70, 50), (5, 15), 20, 50


def half_even(value: Column, places: int) -> Column:
    """Rounded half to even, without the noise of floating sums, which would decide ties."""
    return F.bround(F.round(value, 9), places)


def work_plan(pairs: DataFrame, spark, runs: int = 1, strategies: list[str] = STRATEGIES) -> DataFrame:
    """Every pair under every strategy and run; the two lists are small and fixed."""
    s = spark.createDataFrame([(i, x) for i, x in enumerate(strategies)], "strategy_ord int, prompt_type string")
    r = spark.createDataFrame([(i,) for i in range(runs)], "run int")
    return pairs.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(r))


def widen(scores: DataFrame, strategies: list[str] = STRATEGIES) -> DataFrame:
    """(event, author, {strategy}_score ...): one row for each pair."""
    wide = scores.groupBy("event", "author").pivot("prompt_type", strategies).agg(F.first("score"))
    return wide.select("event", "author", *[F.col(s).alias(f"{s}_score") for s in strategies])


def complete(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have every score."""
    return wide.na.drop(subset=columns)


def strategy_summary(scores: DataFrame, places: int = 6) -> DataFrame:
    """Mean, sample deviation, least and most score of each strategy."""
    return scores.groupBy("prompt_type").agg(
        F.round(F.avg("score"), places).alias("mean_score"),
        F.round(F.stddev_samp("score"), places).alias("std_dev"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def author_ranking(wide: DataFrame, strategies: list[str] = STRATEGIES) -> DataFrame:
    """Authors by their mean over strategies, rounded half-even to 2 places, with ordinal ranks.

    Ranks are counted within ranges of the order, plus the rows of earlier ranges; the driver gets
    one number a range.
    """
    columns = [f"{s}_score" for s in strategies]
    mean = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
    by = complete(wide, columns).withColumn("avg_score", mean).groupBy("author").agg(
        half_even(F.avg("avg_score"), 2).alias("avg_score"),
        half_even(F.stddev_samp("avg_score"), 2).alias("std_dev"),
        F.count("*").alias("events_compared"),
        *[half_even(F.avg(c), 2).alias(c.replace("_score", "_mean")) for c in columns],
    )
    order = [F.desc("avg_score"), F.asc("author")]
    ranged = by.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    # written once, since ranges drawn anew could differ from those that were counted
    path = f"{new_folder(by.sparkSession, 'ranking')}/ranges"
    ranged.write.parquet(path)
    ranged = by.sparkSession.read.schema(ranged.schema).parquet(path)
    before, total = [], 0
    for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        before += [F.lit(r["_p"]), F.lit(total)]
        total += r["n"]
    start = F.create_map(*before)[F.col("_p")] if before else F.lit(0)
    return ranged.withColumn("rank", (F.col("rank") + start).cast("int")).drop("_p")


def self_consistency(runs: DataFrame, places: int = 6) -> DataFrame:
    """Statistics over the runs of each pair and strategy; population deviation; all null, with no
    valid runs, where every run failed."""
    return runs.groupBy("event", "author", "prompt_type").agg(
        F.round(F.avg("score"), places).alias("mean"),
        F.round(F.stddev_pop("score"), places).alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
        F.round(F.max("score") - F.min("score"), places).alias("range"),
        F.count("score").alias("valid_runs"),
        F.count_if(F.col("score").isNull()).alias("errors"),
    )


def run_scores(runs: DataFrame) -> DataFrame:
    """The scores themselves, in order of run, beside each group."""
    return runs.groupBy("event", "author", "prompt_type").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("run", "score")))), lambda s: s["score"]).alias("scores")
    )


def mean_deviation(consistency: DataFrame, places: int = 6) -> DataFrame:
    return consistency.filter(F.col("std").isNotNull()).groupBy("prompt_type").agg(F.round(F.avg("std"), places).alias("mean_std"))


def least_variance(consistency: DataFrame, places: int = 6) -> DataFrame:
    """(prompt_type, mean_std, overall_mean_std): the steadiest strategy."""
    by = mean_deviation(consistency, places)
    overall = consistency.filter(F.col("std").isNotNull()).agg(F.round(F.avg("std"), places).alias("overall_mean_std"))
    best = by.agg(F.min_by("prompt_type", F.struct("mean_std", "prompt_type")).alias("prompt_type"), F.min("mean_std").alias("mean_std"))
    return best.crossJoin(overall)


def problem_pairs(consistency: DataFrame, limit: float = RANGE_LIMIT) -> DataFrame:
    """Pairs whose range is above ``limit`` under some strategy: widest and mean range, and the
    strategies from the widest range down."""
    wide = consistency.filter(F.col("range") > limit)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("range")).alias("r"), F.col("prompt_type").alias("p"))))
    return wide.groupBy("event", "author").agg(
        half_even(F.max("range"), 1).alias("max_range"),
        half_even(F.avg("range"), 1).alias("avg_range"),
        F.count("*").alias("num_strategies"),
        F.array_join(F.transform(ordered, lambda s: s["p"]), ", ").alias("strategies"),
    )


def range_pivot(consistency: DataFrame, strategies: list[str], places: int = 6) -> DataFrame:
    """Mean range, events by strategies."""
    wide = consistency.groupBy("event").pivot("prompt_type", strategies).agg(F.round(F.avg("range"), places))
    return wide.select("event", *strategies)


def band(value: Column, edges: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The first name whose edge ``value`` reaches, from the highest down; the last name below all."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, name in zip(edges, names, strict=False):
        out = out.when(value >= edge, name)
    return out.otherwise(names[-1])


def score_band(score: Column) -> Column:
    return band(score, SCORE_BANDS, ("consistent", "mostly", "partly", "contradictory"))


def reliability(std: Column) -> Column:
    return F.when(std < STD_BANDS[0], "high").when(std < STD_BANDS[1], "medium").when(std.isNotNull(), "low")


def histogram(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): equal bins from the least to the most value, the last one closed."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    rows = values.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).select(at.cast("int").alias("bin"), "lo", "hi")
    step = (F.col("hi") - F.col("lo")) / bins
    return rows.groupBy("bin", "lo", "hi").agg(F.count("*").alias("n")).select(
        "bin", F.round(F.col("lo") + step * F.col("bin"), 6).alias("low"), F.round(F.col("lo") + step * (F.col("bin") + 1), 6).alias("high"), "n"
    )


def box_plot(values: DataFrame, by: str, column: str) -> DataFrame:
    """Quartiles (linear interpolation) and the furthest values within 1.5 times their distance."""
    q = exact_quantiles(values, by, column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    q = F.broadcast(q) if q.count() <= BROADCAST_RANGES else q
    inside = values.join(q, by).filter(F.col(column).between(low, high))
    return inside.groupBy(by).agg(
        *[F.round(F.first(c), 6).alias(c) for c in ("q1", "median", "q3")], F.min(column).alias("whisker_low"), F.max(column).alias("whisker_high")
    )
