"""A corpus pipeline of five stages, each one of the operators in vicinal.llm, over the whole of what its predecessor kept.

What odd rows become: a null or empty text fails the quality rules, so later stages see none. Texts of any length are judged,
scanned and encoded whole. A null doc_id is a document like others; rows that repeat an id and a text are copies of each other, and
near_dedup keeps one row of a group: that of the least id. A null source is a source, and a host, of its own. Ties go by id, then by hash of the text, so reruns agree. An empty
table gives an empty result. Extra columns, whatever their names, are carried to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vicinal.llm.base import dropped, table, written
from vicinal.llm.minhash import unique
from vicinal.llm.mixing import mix
from vicinal.llm.pieces import tokenized
from vicinal.llm.quality import clean
from vicinal.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, frequent lines go from the others. Null and empty texts are rejected."""
    return clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays; a text without words, or with a null id alone, stays."""
    return unique(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; a text without any stays as it is, a null text null."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights: a document stands as often as it is taken, twice at most; one without words is never needed
    for a target but may be taken."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, counted and hashed, and what they decode to; other columns go."""
    return tokenized(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express the shingle signatures, grammars and merges of the later stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the whole table of documents. Each stage's rows are a table in the shared folder that the next
    one reads; it is deleted once that one has written its own."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
