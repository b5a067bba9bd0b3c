"""The training-data queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, lines, periodic, pii, quality, repair, simhash, spm, substring, toxicity
from .common import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(documents(spark, sf_dir), texts=False).drop("kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return quality.scored(docs, quality.fit(docs, labels))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predicted(docs, langid.fit(docs))


def op7_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(documents(spark, sf_dir), spm.Vocabulary.read())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return toxicity.scored(docs, toxicity.fit(docs, labels))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapsed(periodic.looped(documents(spark, sf_dir))))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_chat": op2_chat,
    "op3_substrings": op3_substrings,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_personal": op7_personal,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_nearest": op9_nearest,
    "op10_toxicity": op10_toxicity,
    "op11_periodic": op11_periodic,
    "op12_lines": op12_lines,
    "op13_repair": op13_repair,
}

ORACLE_SQL = {"op2_chat": chat.ORACLE, "op3_substrings": substring.ORACLE, "op9_nearest": ann.ORACLE, "op11_periodic": periodic.ORACLE, "op12_lines": lines.ORACLE, "op13_repair": repair.ORACLE}
