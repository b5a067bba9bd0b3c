"""From raw documents to token ids: quality, near-duplicates, benchmark passages, personal data, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actweave.llm import decontam, pii, quality, simhash, spm
from actweave.llm.common import discard, materialize, spread, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the labelled ones among `docs`."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return simhash.kept(docs)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return pii.redacted(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds `pieces`, the token ids of each text."""
    return spm.encoded(docs, spm.Vocabulary.read())


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated_documents),
    ("personal_data", redacted_documents),
    ("encoding", encoded_documents),
]

#: Trained models, alignments and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`; each stage's rows are written to the shared folder before the next one reads them."""
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = spread(materialize(docs))
            discard(before)
    return docs
