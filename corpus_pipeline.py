"""Corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

toxicity -> one document of each near-duplicate group -> no benchmark passages -> no secrets -> packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticemill.llm import decontamination, jaccard, packing, secrets, toxicity
from noticemill.llm.tables import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the rejecting score by a model learnt from the labelled rows that are not held out."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark text."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark; n_chars is the length of the text that is left."""
    return secrets.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bin, its capacity and their offset in it; lengths are token ids and an end id."""
    import public_tokenizers

    return packing.pack_texts(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

# Learnt scores, latent retrieval and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs, _ = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
