"""The corpus pipeline: documents in, token files out. Each stage works on all that the one before it kept.

The first four stages return the columns they are given; the last writes token files and returns what is read back from
them. Columns that ``documents`` doesn't have of its own go through all stages unread, whatever they are called. Null texts are empty, a
null doc_id is a document of its own, rows that repeat a doc_id and text are decided alike, and an empty table gives no rows. SQL can express neither the hashed n-gram model nor the coder, so there is no oracle; tests hold the stages against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontamination, mixing, near_dedup, quality_rules, token_output
from lattica.llm.common import written

ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns of documents; operators add none of these names.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def extra_apart(stage: Stage) -> Stage:
    """``stage`` with columns besides OWN under names that no operator uses, as operators replace columns of the names they add."""

    @wraps(stage)
    def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        if set(names) <= set(OWN):
            return stage(spark, docs, sf_dir)
        held = docs.toDF(*(c if c in OWN else f"given_{k}" for k, c in enumerate(names)))
        return stage(spark, held, sf_dir).toDF(*names)

    return apart


@extra_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs, labels).filter("kept").select(*docs.columns)


@extra_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    found = near_dedup.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("dropped"))
    return docs.join(found.distinct(), docs["doc_id"] == F.col("dropped"), "left_anti")


@extra_apart
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@extra_apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(mixing.mix(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all copies, and per copy what they hold."""
    return token_output.encode_and_read(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a written table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
