"""Splits that hold whole donors out, balanced over sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.functions.scalars import half_even, order_key

#: Sites of these sizes have fixed numbers of train and validation donors; the rest is for testing.
FIXED_SIZES = {12: (6, 3), 11: (6, 3)}


def donor_split(cells: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 42) -> DataFrame:
    """(donor_id, site, part): within each site donors in seeded hash order, cut by the site's sizes.

    A site needs three donors: the query fails on fewer, as no part may be empty.
    """
    donors = cells.groupBy("donor_id").agg(F.min("site").alias("site"))
    n = F.count("*").over(W.partitionBy("site"))
    at = F.row_number().over(W.partitionBy("site").orderBy(order_key(seed, "donor_id"), "donor_id"))
    df = donors.withColumns({"n": n, "at": at})
    tr, va = F.greatest(F.lit(1), half_even(F.col("n") * train)), F.greatest(F.lit(1), half_even(F.col("n") * val))
    for size, (a, b) in FIXED_SIZES.items():
        tr, va = F.when(F.col("n") == size, a).otherwise(tr), F.when(F.col("n") == size, b).otherwise(va)
    df = df.withColumns({"tr": tr.cast("int"), "va": va.cast("int")})
    df = df.withColumn("tr", F.when(F.col("n") - F.col("tr") - F.col("va") <= 0, F.col("n") - F.col("va") - 1).otherwise(F.col("tr")))
    part = F.when(F.col("at") <= F.col("tr"), "train").when(F.col("at") <= F.col("tr") + F.col("va"), "val").otherwise("test")
    return df.select("donor_id", "site", F.when(F.col("n") < 3, F.raise_error(F.lit("a site needs three donors"))).otherwise(part).alias("part"))


def random_split(cells: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """(cell_id, part): cells in seeded hash order, cut at rounded shares. For debugging only: donors overlap.

    Places come from counts of hash buckets and places within a bucket, so no task sorts all cells.
    """
    df = cells.select("cell_id", order_key(seed, "cell_id").alias("h")).withColumn("b", F.substring("h", 1, 3))
    size = df.groupBy("b").agg(F.count("*").alias("m"))
    size = size.withColumns({"before": F.coalesce(F.sum("m").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("m").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    at = F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("h", "cell_id"))
    out = df.join(F.broadcast(size), "b").withColumn("at", at)  # at most 4096 rows
    a, b = half_even(F.col("n") * train), half_even(F.col("n") * val)
    return out.select("cell_id", F.when(F.col("at") <= a, "train").when(F.col("at") <= a + b, "val").otherwise("test").alias("part"))
