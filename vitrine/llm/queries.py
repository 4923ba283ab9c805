"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import (
    bpe_duckdb, chat_template, conversation_trie, crf_pii, fair_mix, histogram_shard, multi_index, ngram_join, quality_gam,
    separator_scan, simhash, stable_neighbours, token_planes)
from vitrine.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edit_likeness(table(spark, sf_dir, "documents"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document with its end id, counted in flat files: doc_id, n_tokens, and its place."""
    found = separator_scan.count_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    return found.select("doc_id", "n_tokens", "ended", "file", "doc_no", "start")


def op5_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_duckdb.encode_decode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, bodies=False)


def op6_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_template.round_trip(chat_template.with_control_case(table(spark, sf_dir, "conversations")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.duplicate_classes(table(spark, sf_dir, "documents"))


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.taken(table(spark, sf_dir, "documents"))


def op9_histogram_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shard.digests(table(spark, sf_dir, "documents"))


def op10_stable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.hard_negatives(multi_index.relabelled(multi_index.scaled(table(spark, sf_dir, "embeddings"))))


def op12_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_pii.personal_data(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.family_nodes(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_quality_gam, op2_token_planes, op3_simhash, op4_separator_scan, op5_duckdb_bpe, op6_chat_template, op7_ngram_join,
    op8_fair_mix, op9_histogram_shard, op10_stable_neighbours, op11_multi_index, op12_crf_pii,
    op13_conversation_trie)}
ORACLES: dict[str, str] = {"op11_multi_index": multi_index.MINED_SQL, "op13_conversation_trie": conversation_trie.FAMILY_SQL}
