"""URL filter: rules, then gradient-boosted trees on lexical features. DataFrame operations only.

The trees are Spark ML's, trained on labelled URLs; features come from built-in functions. Suffix
statistics are taken over all pages and know no labels: how a URL's length, digits and entropy stand
to the means of its suffix, and the suffix's rarity by powers of ten. (A block rate by suffix, or
anything else that tells suffixes apart, would make trees that learn from rules about suffixes a
table of suffixes.)
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: (verdict, host, path)
Rule = tuple[str, str, str]

FEATURES = (
    "host_length", "path_length", "depth", "host_labels", "host_digit_ratio", "hyphens", "params", "has_fragment", "is_https",
    "length_beside_suffix", "digits_beside_suffix", "entropy_beside_suffix", "suffix_rarity",
)
#: One of so many labelled URLs is kept from training, to measure the trees by.
HELD_OUT_OF = 5


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substr(url, F.position(F.lit("://"), url) + 3)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. At most 1000 rules."""
    if len(rules) > 1000:
        raise ValueError("match_rule takes at most 1000 rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url`` (with ``host`` and ``path`` present); null counts as empty."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    low = F.lower(url)
    share = lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))) / size
    chars = F.array_remove(F.array_distinct(F.split(low, "")), "")
    entropy = F.aggregate(F.transform(chars, share), F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        (count(F.col("host"), ".") + 1).cast("double").alias("host_labels"),
        (digits(url) / size).alias("digit_ratio"),
        (digits(F.col("host")) / F.greatest(F.length("host"), F.lit(1))).alias("host_digit_ratio"),
        count(F.col("host"), "-").cast("double").alias("hyphens"),
        entropy.alias("entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0).alias("params"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(low, F.lit("https://")).cast("double").alias("is_https"),
        F.regexp_extract("host", r"[^.]*\z", 0).alias("suffix"),
    )


class UrlModel:
    """A fitted filter: ``suffixes`` (the means and rarity of each suffix) and the trees."""

    def __init__(self, suffixes: DataFrame, trees, assembler: VectorAssembler):
        self.suffixes, self.trees, self.assembler = suffixes, trees, assembler

    def block_score(self, features: DataFrame) -> DataFrame:
        """Adds ``block_score``, the probability of ``block``."""
        known = _beside_suffix(features, self.suffixes)
        if self.trees is None:
            return known.withColumn("block_score", F.lit(0.0))
        out = self.trees.transform(self.assembler.transform(known))
        return out.withColumn("block_score", vector_to_array("probability")[1])


def suffix_statistics(features: DataFrame) -> DataFrame:
    """(suffix, mean_length, mean_digits, mean_entropy, suffix_rarity) over all rows."""
    rows = features.count()
    return features.groupBy("suffix").agg(
        F.avg("url_length").alias("mean_length"),
        F.avg("digit_ratio").alias("mean_digits"),
        F.avg("entropy").alias("mean_entropy"),
        F.floor(F.log10(F.lit(float(max(rows, 1))) / F.count("*"))).cast("double").alias("suffix_rarity"),
    )


def _beside_suffix(features: DataFrame, suffixes: DataFrame) -> DataFrame:
    return features.join(suffixes, "suffix", "left").select(
        *[F.col(c) for c in features.columns],
        F.coalesce(F.col("url_length") - F.col("mean_length"), F.lit(0.0)).alias("length_beside_suffix"),
        F.coalesce(F.col("digit_ratio") - F.col("mean_digits"), F.lit(0.0)).alias("digits_beside_suffix"),
        F.coalesce(F.col("entropy") - F.col("mean_entropy"), F.lit(0.0)).alias("entropy_beside_suffix"),
        F.coalesce("suffix_rarity", F.lit(99.0)).alias("suffix_rarity"),
    )


def is_held_out(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit("")), F.lit(1)), F.lit(HELD_OUT_OF)) == 0


def fit(features: DataFrame, scratch: Scratch, max_rows: int = 40_000, trees: int = 12, depth: int = 3, seed: int = 7) -> UrlModel:
    """Trees from labelled features (``blocked`` 0.0 or 1.0; null for rows without a label).

    The trees see at most about half of ``max_rows`` distinct URLs of each class, chosen by a hash
    of the URL and weighted back to the class's number of URLs, so a rare class is always present.
    Held-out URLs are not among them. With labels of one class only there are no trees and every
    score is 0.
    """
    suffixes = scratch.keep(suffix_statistics(features), "suffixes")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    labelled = features.filter(F.col("blocked").isNotNull() & ~is_held_out(F.col("url")))
    urls = {r["blocked"]: r["n"] for r in labelled.select("url", "blocked").distinct().groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    if len(urls) < 2:
        return UrlModel(suffixes, None, assembler)
    share = {c: min(1.0, max_rows / 2 / k) for c, k in urls.items()}
    part = F.when(F.col("blocked") == 1.0, share[1.0]).otherwise(share[0.0])
    chosen = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < part * (1 << 30)).dropDuplicates(["url"]).withColumn("weight", 1 / part)
    train = scratch.keep(_beside_suffix(chosen, suffixes).select("blocked", "weight", *FEATURES).repartition(8), "train")
    gbt = GBTClassifier(featuresCol="features", labelCol="blocked", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed)
    return UrlModel(suffixes, gbt.fit(assembler.transform(train).select("features", "blocked", "weight")), assembler)


def judge(pages: DataFrame, rules: list[Rule], threshold: float = 0.5, max_rows: int = 40_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score, held_out) for every page.

    A page that a rule fits takes the rule's verdict and serves as a labelled URL, but for held-out
    ones; the others are judged by trees trained on those labels. ``block_score`` is that of the
    trees for every page.

    Defined cases: a null URL or one without ``://`` has empty host and path and is judged by the
    trees; URLs of any length are read whole; with no labels, or labels of one kind, the trees'
    verdict is allow; rows with one URL are separate rows with equal verdicts and train as one;
    repeated and null ids are ordinary; extra columns are ignored; empty in, empty out.
    """
    scratch = Scratch(pages.sparkSession, "url")
    url = F.col("url")
    parsed = pages.select("page_id", "url", url_host(url).alias("host"), url_path(url).alias("path"))
    ruled = parsed.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    features = scratch.keep(lexical_features(ruled).withColumn("blocked", (F.col("hit.verdict") == "block").cast("double")), "features")
    scored = fit(features, scratch, max_rows).block_score(features)
    method = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "block_score", is_held_out(url).alias("held_out")
    )
