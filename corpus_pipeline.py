"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, source mixing, token output.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its rows are
written as Parquet and read again as the next stage's docs.  All stages but the last return the columns
of documents.  Null and empty texts, and texts without a letter, go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axisloom.llm.common import stored, table
from axisloom.llm.decontaminate import decontaminated
from axisloom.llm.jaccard_join import one_of_each_class
from axisloom.llm.language_id import accepted, fit_language_model
from axisloom.llm.materialise import written_index
from axisloom.llm.mixing import materialised

#: Least calibrated probability of its language with which a document stays.
MIN_LANGUAGE_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, by a model of all labelled documents."""
    return accepted(docs, fit_language_model(docs), min_score=MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingles of Jaccard similarity 0.8 or more."""
    return one_of_each_class(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that align with no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the target weights of their sources ask."""
    return materialised(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; one row per sequence."""
    return written_index(docs, stored_input=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL can't express the trained classifier and the alignment; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
