"""From documents to packed sequences: quality rules, toxicity, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. A stage's result is written as Parquet to the shared folder and read again by the next.

Edge cases are those of the operators: null and empty texts fail the quality rules; rows with a null doc_id are judged like
others, and near-dedup keeps one of a group only if no document with an id is in it; rows that repeat doc_id and text are one
document; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import stored, table
from tidemark.llm.minhash import without_near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality_rules, trusted_documents
from tidemark.llm.toxicity import toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, trusted_documents(spark, sf_dir)).where("kept").select(docs.columns)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of at least 0.8): the smallest doc_id."""
    return without_near_duplicates(docs, width=5, similarity=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", non_toxic), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL can express neither the hashed n-gram model nor the classifier, MinHash and packing. Tests hold each stage against
#: the one before: the models' decisions row by row, near-dedup by brute force over all pairs, packing by its properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
