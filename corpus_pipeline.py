"""The corpus pipeline: quality, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wareloom.llm import decontamination, jaccard, line_dedup, packing, quality
from wareloom.llm.common import Scratch, table

# Every stage but the last returns the columns it gets, whatever else they are called; a table without rows stays so, and
# nulls in other columns than doc_id and text mean nothing to any stage.


def reject_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted to the stage's own input. Null texts and those without
    a word stay; repeated rows stay or go together."""
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, but for the earliest; a document that loses all its words goes too. Earliest
    is by doc_id (null first), then by line. Null and empty texts stay; repeated rows of a doc_id are one document."""
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8 or more), the one of the
    smallest doc_id, and one of its repeated rows. Null and empty texts and rows without a doc_id all stay."""
    return jaccard.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; n_chars follows. All rows stay."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their sequence and place; a null text is an empty one, with its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", reject_junk),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each stage's result written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
