"""The contract's queries: thin wrappers that apply one operator each to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, html_extract, licences, packing, quality, repair, simhash, toxicity

#: The vocabulary file's place is a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a model that has seen no label of the held-out ones."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


#: What both turns of conversation -1 say.
CONTROL = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings, as read back from their formatted texts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL).alias("text"))
    out = chat.format_rows(rows.unionByName(own)).withColumn("turns", chat.turns_of(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("learnt", chat.loss_text(F.col("formatted"), F.col("loss")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from Re-Pair files."""
    return repair.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, zlib.crc32).withColumnRenamed("told", "ids_crc32")


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination report of all documents."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; their source is the host and its language section the path."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents: of the entire text and of its lines."""
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text_sha256", "licence", F.size("notices").cast("long").alias("n_notices"), F.array_join("notices", ",").alias("notices"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every group of equal texts, a row for every document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_token_ids": op3_token_ids,
    "op4_best_fit": op4_best_fit,
    "op5_decontaminate": op5_decontaminate,
    "op6_main_text": op6_main_text,
    "op7_quality": op7_quality,
    "op8_licences": op8_licences,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
}
