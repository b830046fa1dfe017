"""The corpus pipeline: each stage's result is written as Parquet and reread as the next one's documents.

All stages take null and empty texts, null doc_ids, languages and sources, repeated rows, empty tables and more columns,
also some named like a result of the stage; all but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketspark.llm.common import stored, table
from docketspark.llm.mixing import mixed
from docketspark.llm.neardup import deduplicated
from docketspark.llm.packing import pack
from docketspark.llm.quality import good
from docketspark.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on docs and the labels, predicts to be good; all if there are no labels of both kinds. Null and empty texts are scored like any other."""
    return good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8. Texts without words and rows without a doc_id all stay, and so do repeated rows of a doc_id that stays, told apart by nothing."""
    return deduplicated(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; a null text stays null."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; texts without words take no part. A null source is one, too."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the bins; documents without words have no bin."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the classifier's training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
