"""As-of join of a table with itself: for each row the latest earlier source row of its key."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.llm.base import written

#: Rows that a stretch of time has on average, and stretches at most; a stretch of one key is what a window holds together.
STRETCH, STRETCHES = 500, 4_000


def stretched(df: DataFrame, at: str) -> DataFrame:
    """df with _stretch, which rises with `at`: time is cut at quantiles of the rows' times, so a key that has a third of all rows
    has at least a third of the stretches, however few ticks its rows are in and whatever outliers other rows are."""
    n = df.count()
    k = max(1, min(STRETCHES, n // STRETCH))
    cuts = sorted(set(df.approxQuantile(at, [i / k for i in range(1, k)], 0.25 / k))) if k > 1 else []
    if not cuts:
        return df.withColumn("_stretch", F.lit(0.0))
    split = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=split, inputCol="_at", outputCol="_stretch").transform(df.withColumn("_at", F.col(at).cast("double"))).drop("_at")


def latest_before(df: DataFrame, keys: list[str], at: str, source: Column, carry: list[Column], tie: str, out: str = "found") -> DataFrame:
    """df with `out`: struct(at, tie, *carry) of the latest row with `source` and less `at` in the same keys; null if there is none.

    keys and at (a long) may not be null. Of sources at one time the greatest `tie` counts, so repeated rows, and any number of
    rows at one time, are one from the first aggregate on. A running maximum within each stretch of time, then one over what the
    stretches before it end with: a window holds a stretch of a key, or a row for each stretch. Rows themselves aren't in a window;
    they get their answer by a join on key and time, whose skew Spark splits.
    """
    row = F.when(source, F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), *carry))
    times = stretched(written(df.select(*keys, at, row.alias("_source")).groupBy(*keys, at).agg(F.max("_source").alias("_source")), "times"), at)
    by = [*keys, "_stretch"]
    near = times.withColumn("_near", F.max("_source").over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)))
    each = times.groupBy(*by).agg(F.max("_source").alias("_last"))
    before = each.withColumn("_before", F.max("_last").over(W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))).drop("_last").filter("_before is not null")
    found = near.join(before, by, "left").select(*keys, at, F.coalesce("_near", "_before").alias(out)).filter(F.col(out).isNotNull())
    return df.join(found, [*keys, at], "left")
