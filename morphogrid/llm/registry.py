"""The corpus queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import bpe_prefix, chat_preference, fm_decontam, jaccard_join, jump_shards, license_scan, oracles, quality_ranker, repetition_rules, toxic_crf, unigram_count
from .common import default_spec, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_ranker.quality_scores(docs, quality_ranker.train(docs, table(spark, sf_dir, "labels")))


def op3_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.bpe_encode(table(spark, sf_dir, "documents"), default_spec(), keep_ids=False)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fm_decontam.digest(fm_decontam.mark_benchmark(docs, table(spark, sf_dir, "benchmark"), carry=False))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules.repetition_rules(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_crf.toxicity(docs, toxic_crf.train(docs, table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return unigram_count.token_counts(table(spark, sf_dir, "documents"), unigram_count.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op9_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_preference.preference_rows(*chat_preference.cut_replies(table(spark, sf_dir, "conversations")))


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.shard(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_license_scan, op2_quality_ranker, op3_bpe_prefix, op4_decontamination, op5_jaccard_join, op6_quality_rules, op7_toxicity, op8_token_counts, op9_chat_preference, op10_jump_shards, pipeline)


def _shipping(query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _shipping(q) for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": oracles.OP4, "op5_jaccard_join": oracles.OP5, "op6_quality_rules": oracles.OP6, "op9_chat_preference": oracles.OP9}
