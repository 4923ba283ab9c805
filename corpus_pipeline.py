"""The corpus pipeline: stages over ``documents``, each an operator of ``vitrine.llm``.

A stage works on all rows its predecessor kept. Empty tables pass through; nulls are treated as the operators
say: a null text is an empty one, a null id is kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import bpe_duckdb, fair_mix, ngram_join, quality_gam
from vitrine.shared import run_folder, write_out

#: Below this score a document is rejected.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model, fitted on the labelled ones, doesn't reject."""
    return quality_gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shared five-word shingles (Jaccard 0.75 or more), the document of smallest id."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix of sources, repeated as often as it takes them (three times at most)."""
    return fair_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row and their bytes again."""
    return bpe_duckdb.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]
#: The classifier and the merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    folder = run_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = write_out(stage(spark, docs, sf_dir), folder, f"{k}-{name}")
    return docs
