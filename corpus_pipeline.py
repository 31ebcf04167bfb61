"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from contigua.llm import bpe, decontaminate, quality, secret_scan, simhash
from contigua.llm.common import table
from contigua.runtime import materialize

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go. Null and empty texts have no words and go; repeated rows are judged
    alike; an empty table gives an empty one."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: that of the smallest doc_id. Rows without one stay; of
    repeated rows one stays; an empty table gives an empty one."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go, whatever its share of the text. Null and empty texts stay;
    repeated rows and rows without an id are judged by their texts; an empty table gives an empty one."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated rows repeated; the spans of secrets in its text are masked, and n_chars follows. Null
    texts stay null; an empty table gives an empty one."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids as little-endian unsigned 32-bit integers. Null texts
    count as empty (no ids); repeated rows come out repeated; an empty table gives an empty one."""
    return bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SimHash groups, Markov models and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
