"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's `docs`. All stages but the last return the columns of `documents`, more
columns of any names included. An empty table gives an empty one. Rows with null or empty texts pass
all stages: they are not toxic, copies of nothing, without passages or personal data, and of size 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontamination, mixing, near_dedup, pii, storage, toxicity

SHINGLE_WORDS = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled documents here.

    Equal texts stay or go together; a score of 0.5 goes."""
    labels = toxicity.training_labels(_table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words.

    The least doc_id stays (of equal ones the least text hash), a null id only where there is no other;
    of rows that repeat one stays, and of texts without words all."""
    return near_dedup.dedup(docs, SHINGLE_WORDS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; with an empty benchmark all of them."""
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; equal texts are masked alike, a null text stays null."""
    return pii.redact(docs, pii.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them, with each copy's number.

    A null source is a source of its own; texts without words are not taken."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixed),
]

#: Trained models and loopy messages are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; their outputs go to the folder that the cluster shares.

    A stage's output is deleted once the next one is written; the last one's input stays, for the
    result is read from it.
    """
    base = f"{storage.shared_folder(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            storage.dropped(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
