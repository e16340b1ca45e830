"""Agreement of two raters: confusion counts, Cohen's kappa, label rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluation import THRESHOLD


def consistent(rating: Column) -> Column:
    return F.coalesce(rating == "Consistent", F.lit(False)).cast("int")


def reaches(score: Column, threshold: float = THRESHOLD) -> Column:
    """1 for a score at or above the threshold; a missing score is 0."""
    return F.coalesce(score >= threshold, F.lit(False)).cast("int")


def agreement(rated: DataFrame, by: list[str], human: str = "human", judge: str = "judge", places: int = 9) -> DataFrame:
    """Counts, share of equal ratings and kappa of two 0/1 columns; kappa is null where chance
    agreement is certain."""
    h, j = F.col(human), F.col(judge)
    cells = rated.groupBy(*by).agg(
        F.count_if((h == 0) & (j == 0)).alias("tn"),
        F.count_if((h == 0) & (j == 1)).alias("fp"),
        F.count_if((h == 1) & (j == 0)).alias("fn"),
        F.count_if((h == 1) & (j == 1)).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    po, pe = (tp + tn) / n, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n)
    return cells.withColumn("agreement", F.round(po, places)).withColumn("kappa", F.round(F.try_divide(po - pe, F.lit(1.0) - pe), places))


def best_strategy(summary: DataFrame) -> DataFrame:
    """The row with the highest kappa, the first by ``strategy_ord`` among equals."""
    return summary.orderBy(F.col("kappa").desc_nulls_last(), "strategy_ord").limit(1)


def label_rollup(labels: DataFrame, by: list[str], positive: Column) -> DataFrame:
    """Counts of both ratings overall and by each of the columns in ``by``."""
    sets = [[], *[[c] for c in by]]
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in by])
    return labels.withColumn("_p", positive).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(
        level.alias("level"), F.count_if("_p").alias("consistent"), F.count_if(~F.col("_p")).alias("not_consistent")
    )


def match_labels(labels: DataFrame, pairs: DataFrame, on: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(labels with the first pair that matches, labels that match none)."""
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(order))
    firsts = pairs.withColumn("_r", rank).filter("_r = 1").drop("_r")
    return labels.join(firsts, on), labels.join(pairs.select(*on).distinct(), on, "left_anti")
