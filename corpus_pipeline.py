"""Corpus pipeline: the stages that turn raw documents into a training corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontamination, mixing, ngram_join, sharding, toxicity
from barloom.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the labels teach the score.

    Null and empty texts, null and repeated ids are judged like any others; where
    nothing can be learned every row stays; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels, learn=toxicity.part("doc_id", 5) != 0))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents.

    That of the smallest id, so ties are settled; rows without words link with
    nothing and stay, one of those that agree in id and text; rows without an id
    all stay; an empty table stays empty.
    """
    return ngram_join.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts hold none, null and empty items are held by none;
    repeated rows go or stay together; empty tables change nothing.
    """
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of scarce domains more often, up to their targets.

    Texts without words have a rate like any other; repeated rows have equal
    rates; without labels, or any words, every row stays once.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(docs, mixing.fit(docs, mixing.languages(docs, labels)))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it.

    Null texts and ids, ties and repeated rows get places of their own; an empty
    table stays empty; columns named shard and slot are replaced.
    """
    return sharding.shard(docs)


STAGES: list = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order; a stage's table goes once the next one is written."""
    scratch, last = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
