"""The corpus pipeline: from documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkmill.llm import bpe, langid, mixing, simhash
from inkmill.llm.common import Scratch, table
from inkmill.llm.queries import tokenizer_path

#: A source is drawn at most this often; every document is drawn at least once.
REPETITION = 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that language identification rejects: those without a letter and those
    far from every language learned from the labelled ones."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources nearer to equal weights: small sources' documents are repeated, within the limit."""
    return mixing.repeat(docs, repetition=REPETITION)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with what is needed to trace it."""
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Language identification and SimHash have no form in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
