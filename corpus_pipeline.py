"""From documents to packed training sequences, each stage over all that the one before kept.

Every stage's result is written as Parquet in the shared folder and read again as the next one's documents; what a stage
stored on its way, and the result before, are deleted then.

Edge cases: a null text is an empty one in every stage, so of all null, empty and blank texts one row stays after exact dedup; repeated rows
are copies of one another, of which one stays; a null doc_id is carried through; without labels nothing is toxic, without
benchmark items nothing is contaminated; empty documents give an empty result; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rollweave.llm import common, decontam, exact_dedup, packing, simhash, toxicity
from rollweave.llm.queries import END_ID, table, tokenizer_path


#: Tables that the results of stages read; a stage's result has been written when the next stage is called.
_read_by_results: list = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first deletes what the one before left, unless ``docs`` still reads it."""

    @wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.discard_unread(_read_by_results, docs)
        with common.noted(_read_by_results):
            return function(spark, docs, sf_dir)

    return staged


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.deduplicate(docs)


@_stage
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component."""
    return simhash.one_of_each(docs)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    return packing.pack_documents(docs, tokenizer_path(), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Fingerprints, learnt scores and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with common.temporary():
            docs = common.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(before)
    return docs
