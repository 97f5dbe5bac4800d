"""A training-corpus pipeline: filter, dedup, mix, tokenise. Each stage's result is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rangeloom.llm import bpe, exact_dedup, mixing, simhash, toxicity
from rangeloom.llm.common import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model is fitted on the labels of the documents at hand."""
    return toxicity.apply(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those whose texts are equal without white space."""
    return exact_dedup.apply(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by close fingerprints."""
    return simhash.apply(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none to three times."""
    return mixing.apply(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids as little-endian unsigned 32-bit integers."""
    return bpe.encode_decode(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: Stages that hash, score and tokenise have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
