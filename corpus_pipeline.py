"""The corpus pipeline: toxicity, line de-duplication, near-duplicates, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.llm import lines, packing, secrets, simhash, toxicity
from auralake.llm.common import stage_alone

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar lines the first one stays."""
    return lines.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    return simhash.drop_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", clean), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_documents), ("secrets", redact), ("packing", pack)]

#: Models, MinHash, XXH64 and BPE have no SQL; the tests hold run() against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage_alone(lambda step=step, docs=docs: step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
