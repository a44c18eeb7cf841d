"""Exact order statistics of any number of values, without a task that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.session import dropped, written

#: Values up to which one task finds a median (a map of that many numbers at most), and cells of a histogram.
FEW, CELLS = 100_000, 1_024


def selected(values: DataFrame, rank: int) -> float:
    """The value of a rank, from 0, among the doubles in the column v; none may be null or NaN. values is read once a round.

    Each round counts the values that are left in equal cells between their least and largest, and goes on with the rank's cell, whose
    own least and largest are known then. A round that parts nothing can't be: the least and the largest are in different cells.
    """
    some = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, n = some.lo, some.hi, some.n
    while lo < hi and n > FEW:
        step = hi / CELLS - lo / CELLS
        cell = F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((F.col("v") - lo) / step))).cast("int") if step > 0 else F.when(F.col("v") < hi, 0).otherwise(1)
        within = values.filter(F.col("v").between(lo, hi))
        cells = within.groupBy(F.when(F.col("v") == hi, CELLS).otherwise(cell).alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("cell").collect()  # a row a cell
        for c in cells:
            if rank < c.n:
                lo, hi, n = c.lo, c.hi, c.n
                break
            rank -= c.n
    if lo == hi:
        return lo
    return values.filter(F.col("v").between(lo, hi)).orderBy("v").offset(rank).limit(1).first().v


def median(df: DataFrame, column: str) -> float | None:
    """The median of a column's values that aren't null: the mean of the two in the middle. NaN counts as largest, as Spark orders it.
    Without values there is none."""
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    rows = written(rows, "values")
    size = rows.agg(F.count("*").alias("n"), F.count_if(~F.isnan("v")).alias("real")).first()
    if size.n <= FEW:
        out = rows.agg(F.median("v")).first()[0]
    else:
        real = rows.filter(~F.isnan("v"))
        mid = sorted({(size.n - 1) // 2, size.n // 2})
        found = [selected(real, r) if r < size.real else float("nan") for r in mid]
        out = found[0] if len(found) == 1 else found[0] / 2 + found[1] / 2
    dropped(rows)
    return out
