"""The corpus pipeline: language ID, line dedup, near dedup, decontamination, packing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

* language_id drops documents without a language: null texts, texts without a letter, and words no table knows.
* line_dedup keeps every document and cuts lines that repeat an earlier one; a text may become empty.
* near_dedup keeps the least doc_id of each group of near copies; empty texts are one group.
* decontamination drops documents that overlap a benchmark item.
* packing returns one row per piece of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.decontamination import drop_contaminated
from panelwright.llm.language_id import drop_unidentified
from panelwright.llm.line_dedup import without_repeated_lines
from panelwright.llm.packing import packed
from panelwright.llm.simhash_dedup import drop_near_copies
from panelwright.session import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unidentified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the classifier, the fuzzy links or the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is a written table before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
