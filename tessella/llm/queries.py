"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe_automaton, kd_shards, mixing, quality, rlz, secret_scan, simhash, token_count, token_store, va_topk
from tessella.llm.common import read_table

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def op1_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe_automaton.encode_digests(docs, public_tokenizers.path(WORD_TOKENIZER))


def op2_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return va_topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = token_store.write_ids(docs, public_tokenizers.path(BYTE_TOKENIZER), end_id=2)
    return token_store.read_checks(spark, path)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, tau=4)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_count.count_tokens(docs, public_tokenizers.path(BYTE_TOKENIZER), limit=1024)


def op7_rlz_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz.remove_repeats(read_table(spark, sf_dir, "documents"), window=50, keep_text=False)
    return out.withColumnRenamed("kept", "kept_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read_table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(read_table(spark, sf_dir, "documents"), shards=24)


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
