"""The corpus pipeline: documents to packed training sequences. Each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kagajflow.llm import common, near_dedup, op2_packing, op3_language, op6_decontamination, op9_line_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (operator 3)."""
    keyed = docs.withColumn("_key", common.row_key())
    judged = op3_language.of_documents(keyed, op3_language.fit(docs), id_col="_key")
    return common.without_rows(docs, common.stored(judged.where("not accepted").select("_key.*"), "rejected"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more of them hold, but in one (operator 9)."""
    return op9_line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 8)."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 6)."""
    keyed = docs.select(common.row_key().alias("_key"), "text")
    found = op6_decontamination.contamination(keyed, common.table(spark, sf_dir, "benchmark"), id_col="_key")
    return common.without_rows(docs, common.stored(found.where("contaminated").select("_key.*"), "contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences (operator 2)."""
    return op2_packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trigram models, tokens and bit fingerprints aren't SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's documents are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
