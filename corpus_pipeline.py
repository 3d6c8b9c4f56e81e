"""Training-data pipeline over documents: stages that each call one operator and hand their rows on."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import bytebpe, decontam, langid, nearcopies, pii
from traceloom.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that can be learned; the others go."""
    return langid.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked."""
    return pii.mask_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and decoded bytes of every document that is left."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.digests(bytebpe.encode_documents(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("language_id", identify_language),
    ("simhash", remove_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode),
]

# Automata, fingerprints, seeds, a random field and tokenization are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
