"""The registered queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import alignment, bytebpe, collocations, decontam, htmltext, langid, pii, simhash, substringdedup, suffixdedup, tokencount, topk, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_documents(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 2048 AS over_limit")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.digests(bytebpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(suffixdedup.remove_repeats(table(spark, sf_dir, "documents")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths).drop("a", "b")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substringdedup.digests(substringdedup.remove_repeats(table(spark, sf_dir, "documents")))


QUERIES = {"op1_topk": op1_topk, "op2_language_id": op2_language_id, "op3_simhash": op3_simhash, "op4_url_filter": op4_url_filter, "op5_personal_data": op5_personal_data, "op6_decontamination": op6_decontamination, "op7_token_counts": op7_token_counts, "op8_main_text": op8_main_text, "op9_byte_bpe": op9_byte_bpe, "op10_suffix_dedup": op10_suffix_dedup, "op11_alignment": op11_alignment, "op12_collocations": op12_collocations, "op13_substring_dedup": op13_substring_dedup}
ORACLES: dict[str, str] = {"op1_topk": topk.ORACLE, "op4_url_filter": urlfilter.ORACLE, "op12_collocations": collocations.ORACLE, "op13_substring_dedup": substringdedup.ORACLE}
