"""Registered queries of the text operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from contigua.llm import bpe, decontaminate, embedding_dedup, filter_audit, langid, quality, secret_scan, simhash, spelling, suffix_tree, token_counts, toxicity, training_order
from contigua.llm.common import table
from contigua.runtime import scratch_path, ship

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every distinct text is encoded."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), scratch_path(spark, "token-cache"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null texts have no words and fail."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels outside the held-out fold; empty and null texts get a score too."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards go to a new folder of the shared one; the rows say where every packed sequence is."""
    docs = table(spark, sf_dir, "documents")
    return training_order.materialise(docs, scratch_path(spark, "training-order"), public_tokenizers.path(RANKS))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and word-less texts have fingerprint zero."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document as digests; null texts count as empty."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; null texts have none."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned outside the held-out fold; texts that are null or have no letter are ``und``."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item of the benchmark; null texts have no words."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from six of seven folds, scored on all; null texts count as empty."""
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal labels with a cosine of 0.98 or more."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    named = [
        op1_token_counts, op2_quality_rules, op3_toxicity, op4_training_order, op5_simhash_near_dedup, op6_bpe_codec, op7_secret_scan, op8_language_id, op9_decontamination, op10_lm_scoring, op11_filter_audit, op12_embedding_near_dedup, op13_spelling_variants,
        pipeline,
    ]
    return {f.__name__: _shipped(f) for f in named}


def _shipped(f: Query) -> Query:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return call


def oracle_sql() -> dict[str, str]:
    from contigua.llm import oracles

    return dict(oracles.SQL)
