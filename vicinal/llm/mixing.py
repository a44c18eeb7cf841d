"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.llm.base import table, words, written

#: Weights of the sources in order of code points, null last, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has this percentage of all words, and of no source more than CAP times its words.
PERCENT, CAP = 150, 2
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP) -> DataFrame:
    """sizes (src, none, source_size) with weight and target, one row per source.

    A source is at its cap exactly if its cap over its weight is at most the common level; the level follows from running
    sums in order of that ratio, so there is no loop. Sums are of whole numbers, and each target is one division. Weights go by a
    source's place among all sources, so one task orders them: a row of a few numbers a source, not of their documents.
    """
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.orderBy("none", "src")) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("weight", pick.cast("long")).withColumn("ratio", F.col("source_size") / F.col("weight"))
    up, everything = W.orderBy("ratio", "none", "src").rowsBetween(W.unboundedPreceding, W.currentRow), W.orderBy("ratio", "none", "src").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumns({"sum_size": F.sum("source_size").over(up), "sum_weight": F.sum("weight").over(up), "all_size": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything)})
    # what the sources from this one on would share, if all before it are at their cap
    rest = F.col("all_size") * percent - 100 * cap * (F.col("sum_size") - F.col("source_size"))
    left = F.col("all_weight") - F.col("sum_weight") + F.col("weight")
    df = df.withColumns({"rest": rest, "left": left})
    # capped: its share would exceed its cap; in order of ratio the capped sources come first
    df = df.withColumn("capped", F.col("rest") * F.col("weight") >= 100 * cap * F.col("source_size") * F.col("left"))
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", "none", "src", "rest", "left"))).over(W.partitionBy(F.lit(1)))
    df = df.withColumn("level", level)
    target = F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * F.col("level.rest") / (100 * F.col("level.left")))
    return df.select("src", "none", "source_size", target.alias("target"))


def sampled(docs: DataFrame, carry: list[str], seed: str = SEED, **rules: object) -> DataFrame:
    """The columns `carry` of each row of docs as `row`, with size, source_size, target and copies (0 to CAP).

    All documents of a source are expected equally often, target over source size times. Within a source they stand in order of
    size class, then of a seeded hash; the prefix sum of expected copies is the place in that order times the rate, and a
    document is emitted once for each whole number that the prefix sum plus a random offset crosses. Neighbours in this order
    have like sizes, so a source's words come near its target. Places come from counts of (source, size class, hash bucket)
    cells, whose running sums are few rows, and places within a cell: no task holds a source.

    The table is read once: what is needed of each row is written with its size and hash, and cells are counted from that.

    Null text has size 0; null source is a source of its own, last, and apart from an empty one; repeated rows are sampled each;
    texts count whole; no rows give no rows; other columns are carried if they are asked for, whatever their names.
    """
    df = docs.select(F.struct(*carry).alias("row"), F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().cast("int").alias("none"), F.size(words("text")).cast("long").alias("size"), F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("h"), F.xxhash64("text").alias("t"))
    df = written(df.withColumns({"class": F.floor(8 * F.log2(F.col("size") + 1)).cast("int"), "bucket": F.substring("h", 1, 3)}), "mixing")
    cells = written(df.groupBy("src", "none", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "cells")
    # places before a cell: those of lesser classes of its source, and of its class those of lesser buckets
    classes = cells.groupBy("src", "none", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sizes = classes.groupBy("src", "none").agg(F.sum("words").alias("source_size"))
    less = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lower = classes.select("src", "none", "class", less(W.partitionBy("src", "none").orderBy("class")).alias("lower")).join(targets(sizes, **rules), ["src", "none"])
    placed = cells.withColumn("earlier", less(W.partitionBy("src", "none", "class").orderBy("bucket"))).join(lower, ["src", "none", "class"])
    placed = placed.withColumn("before", F.col("earlier") + F.col("lower")).drop("n", "words", "earlier", "lower")
    at = F.row_number().over(W.partitionBy("src", "none", "class", "bucket").orderBy("h", "size", "t"))
    df = df.withColumn("at", at).join(placed, ["src", "none", "class", "bucket"]).withColumn("place", F.col("before") + F.col("at"))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("none").cast("string"), F.col("src"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("place") * rate + offset) - F.floor((F.col("place") - 1) * rate + offset)
    return df.select("row", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: str = SEED, **rules: object) -> DataFrame:
    """The mix: each row of docs as often as it is taken."""
    return sampled(docs, docs.columns, seed, **rules).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampled(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
