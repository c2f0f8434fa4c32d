"""Corpus cleaning as stages that each rewrite the documents.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``; the last returns the
encoded corpus.  ``run`` applies them one after the other; a caller may write each result and read it again instead.
Nulls, empty and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tonearm.llm import bpe, decontam, minhash, pii, toxicity

SHINGLE, PERCENT = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar doesn't predict toxic."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose five-word shingles link at 0.8 or more."""
    return minhash.keep_one(docs, shingle=SHINGLE, percent=PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with other numbers or names."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and secrets replaced by their kind."""
    return pii.mask(docs, "text", "n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, the ids, and digests of the ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True, forget=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("benchmark", without_benchmark),
    ("personal_data", mask_personal_data),
    ("bpe", encode),
]

#: The grammar's training, connected components and the field have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
