"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent (1 keeps the shares, 0 makes all sources
equal) and normalised. The exponent is found by repeated section of [0, 1]: each pass evaluates
129 exponents in one aggregation over the per-source totals and keeps the interval that holds the
target, an entropy to reach or a limit on repetitions.

The weights are realised over a budget of tokens. A source that is drawn e times over is repeated
for floor(e) whole epochs, and for the rest of e in part. In each epoch its blocks (documents by a
hash of the id) are permuted, and the documents within each block; the part is a prefix of that
order: whole blocks by the sums of their tokens, then of the one block at the cut whole parts by
sums, and of the one part at the cut a prefix (a 16-millionth of the source's documents). A row's copies follow from its own hashes and one row of cuts for each source, so texts are never
shuffled, and a source with a third of all rows is spread over all tasks.

Defined cases: a null source is a source; null texts have no tokens; documents of a source without
tokens appear once; repeated rows share their place in the order, so they are in or out of the
last epoch together, and so are rows with a null id; an empty table gives an empty result; extra
columns are carried by ``repeat``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, set_aside

BLOCKS, SEED, PROBES = 4096, 11, 129
#: Sources up to this number have their cuts broadcast (under 16 MB); beyond, Spark picks the join.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _block(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(SEED)), F.lit(BLOCKS)).cast("int")


def _block_order(block: Column, epoch: Column) -> Column:
    # distinct for distinct blocks: a permutation's order needs no ties
    return F.shiftleft(F.shiftright(F.xxhash64(block, epoch.cast("int"), F.lit(SEED)), 12), 12).bitwiseOR(block.cast("long"))


def _doc_order(doc_id: Column, epoch: Column) -> Column:
    return F.xxhash64(doc_id, epoch.cast("int"), F.lit(SEED + 1))


def find_exponent(totals: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: float | None = None, passes: int = 3) -> float:
    """The exponent nearest 1 whose weights reach ``entropy`` (nats), or the one nearest 0 whose
    sources are drawn at most ``repetition`` times. ``totals``: source, tokens (above 0).

    Without ``budget`` repetitions are counted for the least budget that has every source whole.
    A target that no exponent meets gives the nearest end.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give an entropy or a repetition limit")
    whole = totals.agg(F.sum("tokens").alias("t")).first()["t"]
    if not whole:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(passes):
        steps = [low + (high - low) * i / (PROBES - 1) for i in range(PROBES)]
        p = F.col("tokens") / float(whole)
        rows = totals.select(p.alias("p"), F.explode(F.array(*map(F.lit, steps))).alias("x")).groupBy("x").agg(
            F.sum(F.pow("p", "x")).alias("z"),
            F.sum(F.pow("p", "x") * F.log("p")).alias("zl"),
            F.max(F.pow("p", F.col("x") - 1)).alias("most"),
            F.min(F.pow("p", F.col("x") - 1)).alias("least"),
        )
        ok = []
        for r in sorted(rows.collect(), key=lambda r: r["x"]):
            if entropy is not None:
                ok.append(math.log(r["z"]) - r["x"] * r["zl"] / r["z"] >= entropy - 1e-12)
            else:
                drawn = r["most"] / r["least"] if budget is None else r["most"] / r["z"] * budget / whole
                ok.append(drawn <= repetition * (1 + 1e-12))
        # entropy falls with the exponent and so do repetitions
        if entropy is not None:
            i = max((j for j, good in enumerate(ok) if good), default=0)
            if i == PROBES - 1:
                return steps[-1]
            low, high = steps[i], steps[i + 1]
        else:
            i = min((j for j, good in enumerate(ok) if good), default=PROBES - 1)
            if i == 0:
                return steps[0]
            low, high = steps[i - 1], steps[i]
    return low if entropy is not None else high


def plan(rows: DataFrame, scratch: Scratch, entropy: float | None = None, repetition: float | None = None, budget: float | None = None) -> DataFrame:
    """(source, weight, epochs, cut_block, cut_doc): how far each source is drawn.

    ``rows``: doc_id, source, tokens of every document, as a written table.
    """
    totals = scratch.keep(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "totals")
    counted = totals.filter("tokens > 0")
    x = find_exponent(counted, entropy, repetition, budget)
    sums = counted.agg(F.sum("tokens").alias("t"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(x))).alias("z")).first()
    power = F.pow(F.col("tokens").cast("double"), F.lit(x))
    weighted = counted.withColumn("weight", power / F.lit(float(sums["z"] or 1)))
    if budget is None:
        budget = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    # an epoch that is whole but for rounding is whole
    drawn = F.col("weight") * F.lit(float(budget)) / F.col("tokens")
    epochs = F.when(F.abs(drawn - F.round(drawn)) < 1e-9, F.round(drawn)).otherwise(drawn)
    drawn_rows = weighted.select("source", "tokens", "weight", epochs.alias("epochs")).unionByName(
        totals.filter("tokens = 0").select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"))
    )
    drawn_rows = scratch.keep(
        drawn_rows.withColumn("whole", F.floor("epochs").cast("int")).withColumn("quota", ((F.col("epochs") - F.col("whole")) * F.col("tokens")).cast("long")), "drawn"
    )

    def by_source(df: DataFrame, other: DataFrame) -> DataFrame:
        o = other.withColumnRenamed("source", "_source")
        return df.join(o, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    few = F.broadcast(drawn_rows) if drawn_rows.count() <= BROADCAST_SOURCES else drawn_rows
    # the block at the cut: at most BLOCKS sums for each source
    sums_of = rows.groupBy("source", _block(F.col("doc_id")).alias("block")).agg(F.sum("tokens").alias("b"))
    placed = by_source(sums_of, few.select("source", "whole", "quota")).withColumn("block_order", _block_order(F.col("block"), F.col("whole")))
    upto = F.sum("b").over(Window.partitionBy("source").orderBy("block_order"))
    at_cut = placed.withColumn("upto", upto).filter("upto > quota").groupBy("source").agg(
        F.min_by("block", "block_order").alias("block"), F.min("block_order").alias("cut_block"), F.min_by(F.col("quota") - (F.col("upto") - F.col("b")), "block_order").alias("left")
    )
    at_cut = scratch.keep(at_cut, "cut")
    # within it, a prefix of its documents
    cuts = F.broadcast(at_cut) if at_cut.count() <= BROADCAST_SOURCES else at_cut
    inside = by_source(rows, few.select("source", "whole")).withColumn("block", _block(F.col("doc_id")))
    o = cuts.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "left")
    inside = inside.join(o, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    inside = scratch.keep(inside.select("source", "tokens", "left", _doc_order(F.col("doc_id"), F.col("whole")).alias("doc_order")), "inside")
    # first whole parts of the block by the upper bits of that order, then the documents of one part
    part = F.shiftright("doc_order", 52).alias("part")
    parts = inside.groupBy("source", part).agg(F.sum("tokens").alias("b"), F.first("left").alias("left"))
    upto = F.sum("b").over(Window.partitionBy("source").orderBy("part"))
    part_cut = parts.withColumn("upto", upto).filter("upto > left").groupBy("source").agg(
        F.min("part").alias("_part"), F.min_by(F.col("left") - (F.col("upto") - F.col("b")), "part").alias("_left")
    )
    part_cut = scratch.keep(part_cut.withColumnRenamed("source", "_source"), "part")
    few_parts = F.broadcast(part_cut) if part_cut.count() <= BROADCAST_SOURCES else part_cut
    within = inside.join(few_parts, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("doc_order", 52) == F.col("_part")))
    so_far = F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_order").rangeBetween(Window.unboundedPreceding, 0))
    fits = F.max(F.when(F.col("so_far") <= F.col("_left"), F.col("doc_order")))
    # nothing of the part fits: the cut lies below it
    below = F.when(F.min("_part") > -2048, F.shiftleft(F.min("_part").cast("long"), 52) - 1)
    last = within.withColumn("so_far", so_far).groupBy("source").agg(F.coalesce(fits, below).alias("cut_doc"))
    both = drawn_rows.join(at_cut.select(F.col("source").alias("s1"), "cut_block"), F.col("source").eqNullSafe(F.col("s1")), "left")
    both = both.join(last.select(F.col("source").alias("s2"), "cut_doc"), F.col("source").eqNullSafe(F.col("s2")), "left")
    return scratch.keep(both.select("source", "weight", "epochs", "whole", "cut_block", "cut_doc"), "plan")


def _with_copies(docs: DataFrame, plan_: DataFrame) -> DataFrame:
    few = plan_.select(F.col("source").alias("_source"), "whole", "cut_block", "cut_doc")
    few = F.broadcast(few) if plan_.count() <= BROADCAST_SOURCES else few
    at = _block_order(_block(F.col("doc_id")), F.col("whole"))
    extra = (at < F.col("cut_block")) | ((at == F.col("cut_block")) & (_doc_order(F.col("doc_id"), F.col("whole")) <= F.col("cut_doc")))
    copies = F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int")
    return docs.join(few, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", copies).drop("_source", "whole", "cut_block", "cut_doc")


def _rows(docs: DataFrame, scratch: Scratch, text: str) -> DataFrame:
    return scratch.keep(docs.select("doc_id", "source", word_count(F.col(text)).alias("tokens")), "rows")


def mix(docs: DataFrame, text: str = "text", **target) -> DataFrame:
    """(doc_id, source, epoch, block, block_order, doc_order, tokens): one row for each time a
    document is drawn. Sorted by epoch, block_order and doc_order, the rows of a source are its
    permuted blocks. ``target``: entropy or repetition, and budget, as in ``plan``."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = _rows(docs, scratch, text)
    drawn = _with_copies(rows, plan(rows, scratch, **target)).filter("_copies > 0")
    epoch = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("epoch")
    each = drawn.select("doc_id", "source", epoch, _block(F.col("doc_id")).alias("block"), "tokens")
    return each.select(
        "doc_id", "source", "epoch", "block", _block_order(F.col("block"), F.col("epoch")).alias("block_order"), _doc_order(F.col("doc_id"), F.col("epoch")).alias("doc_order"), "tokens"
    )


def repeat(docs: DataFrame, text: str = "text", **target) -> DataFrame:
    """``docs`` with every row as often as it is drawn, in its own columns."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows, back = set_aside(docs, "doc_id", "source")
    drawn = _with_copies(rows, plan(_rows(docs, scratch, text), scratch, **target))
    return drawn.filter("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).select(*back)
