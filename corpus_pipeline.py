"""A cleaning pipeline over the documents table: each stage works on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from morphogrid.llm import bpe_prefix, fm_decontam, jaccard_join, quality_ranker, repetition_rules
from morphogrid.llm.common import checkpoint_folder, default_spec, table
from morphogrid.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition_rules.kept_rows(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the cut or above; the ranking learns from the labels of the whole documents table."""
    model = quality_ranker.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_ranker.kept_rows(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates."""
    return jaccard_join.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, cut until no window of a benchmark item is left; n_chars, where it is a column, is counted anew in those cut."""
    return fm_decontam.remove_passages(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded text."""
    return bpe_prefix.bpe_encode(docs, default_spec(), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can express neither the classifier nor the encoding; tests check what each stage promises.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; each result is written to the shared folder and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
