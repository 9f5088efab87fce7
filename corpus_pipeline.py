"""The training-data pipeline: each stage works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, simhash, substring, toxicity
from millrace.llm.storage import settle

#: Most bytes of an Arrow batch between Spark and its Python workers: two tasks of an
#: executor hold a few batches each, however long the texts and sets in them are.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Set the session's bound, which counts when a stage's result is written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic probability stays below the chain's threshold."""
    bound_batches(spark)
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, chain, prefix="_chain_p_")
    return scored.where(F.col("_chain_p_toxic") < chain.thresholds["toxic"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8 or more)."""
    bound_batches(spark)
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; the character count follows."""
    bound_batches(spark)
    cut = substring.dedup(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("removed_words") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken."""
    bound_batches(spark)
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False, forget=True)
    return coded.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]
#: SQL has neither the classifier nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
