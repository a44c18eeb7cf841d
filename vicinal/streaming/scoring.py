"""Neighbours of a stream of query cells. Held-out cells never change the training cells, so each batch stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinal.operators.graph import nearest


def score(batch: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(node, yhat, votes): the commonest label among the k nearest training nodes, ties to the least label."""
    n = nearest(batch, train, k).join(train.select(F.col("node").alias("src"), "y"), "src").groupBy(F.col("dst").alias("node"), "y").agg(F.count("*").alias("votes"))
    return n.groupBy("node").agg(F.max_by("y", F.struct("votes", -F.col("y"))).alias("yhat"), F.max("votes").alias("votes"))


def score_stream(stream: DataFrame, train: DataFrame, k: int, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the scores of each batch of (node, x) to a folder of its number, so a batch that is repeated after a failure
    replaces what it wrote."""

    def one(batch: DataFrame, number: int) -> None:
        score(batch, train, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
