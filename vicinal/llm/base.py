"""What the operators of this subpackage share: word pattern, reading, written tables, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.session import dropped, written

__all__ = ["WORD", "dropped", "row_key", "table", "words", "written"]

#: A word is a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | Column) -> Column:
    """All words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD), F.lit(0))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """k1, k2: what tells rows apart. Repeated rows (same id, same text) have the same key and get the same result."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)).cast("long")).alias("k1"), F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), F.col(text)).alias("k2")]
