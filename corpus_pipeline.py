"""The corpus pipeline: documents through the operators of ``driftrank.llm``."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from driftrank.llm import quality, secret_scan
from driftrank.llm.decontaminate import clean
from driftrank.llm.ngram_jaccard import one_of_each
from driftrank.llm.packing import pack
from driftrank.llm.tables import read, vocabulary, written
from driftrank.session import configure, ensure_checkpoint_dir


def _ready(stage):
    """``stage`` in a session that has the settings and the package on its executors."""
    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        configure(spark)
        return stage(spark, docs, sf_dir)
    return call


@_ready
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


@_ready
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id."""
    return one_of_each(docs)


@_ready
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


@_ready
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secret_scan.redacted(docs, secret_scan.fit(docs))


@_ready
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token pieces, packed into sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: training, the forest and the packing order cannot be said in SQL; tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
