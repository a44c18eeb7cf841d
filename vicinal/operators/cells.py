"""Filters, projections, checks and counts on entities (cells) and their groups (donors, sites)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.functions.scalars import order_key


def included(cells: DataFrame, manifest: DataFrame, key: str = "donor_id") -> DataFrame:
    """Cells whose donor the manifest includes."""
    return cells.join(manifest.filter("inclusion_status = 'included'").select(key), key, "left_semi")


def with_site(cells: DataFrame, manifest: DataFrame, key: str = "donor_id") -> DataFrame:
    """The manifest's site of each cell's donor; null for an unknown donor."""
    return cells.drop("site").join(manifest.select(key, "site"), key, "left")


def annotated(cells: DataFrame, label: str, junk: list[str]) -> DataFrame:
    return cells.filter(F.col(label).isNotNull() & ~F.col(label).isin(junk))


def min_group(cells: DataFrame, key: str, least: int) -> DataFrame:
    """Cells of groups that have `least` cells or more."""
    large = cells.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(key)
    return cells.join(large, key, "left_semi")


def capped(cells: DataFrame, key: str, n: int, seed: int, ident: str) -> DataFrame:
    """At most n cells of each group, in seeded hash order. WindowGroupLimit keeps n a task before the shuffle."""
    return cells.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order_key(seed, ident), ident))).filter(F.col("_r") <= n).drop("_r")


def label_ids(cells: DataFrame, label: str) -> DataFrame:
    """(label, y): dense ids in order of labels; there are as many rows as classes."""
    return cells.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("y", (F.row_number().over(W.orderBy(label)) - 1).cast("int"))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of row by the given column values, 0 where there is none, and their total."""
    out = df.groupBy(row).pivot(col, values).count().na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return out.withColumn("total", total)


def margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of every pair, row and column, 'Total' for sums."""
    cube = df.cube(row, col).agg(F.count("*").alias("n"), F.grouping(row).alias("g1"), F.grouping(col).alias("g2"))
    return cube.select(F.when(F.col("g1") == 1, "Total").otherwise(F.col(row).cast("string")).alias(row), F.when(F.col("g2") == 1, "Total").otherwise(F.col(col).cast("string")).alias(col), "n")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df itself; missing columns are an error that lists them."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def violations(cells: DataFrame, counts: DataFrame, ident: str = "cell_id", donor: str = "donor_id", label: str = "cell_type", least: int = 1) -> DataFrame:
    """(check, bad): how many rows break each rule; all zero for a sound table."""
    empty = cells.limit(1).agg((1 - F.count("*")).alias("bad")).select(F.lit("nonempty").alias("check"), "bad")
    twice = cells.groupBy(ident).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad")).select(F.lit("unique_id").alias("check"), "bad")
    nulls = cells.agg(F.count_if(F.col(donor).isNull() | F.col(label).isNull()).alias("bad")).select(F.lit("nulls").alias("check"), "bad")
    wrong = counts.agg(F.count_if((F.col("n") < 0) | (F.col("n") % 1 != 0)).alias("bad")).select(F.lit("counts").alias("check"), "bad")
    small = cells.groupBy(donor).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") < least).alias("bad")).select(F.lit("min_cells").alias("check"), "bad")
    return empty.union(twice).union(nulls).union(wrong).union(small)


def overlaps(split: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one part."""
    return split.groupBy(key).agg(F.count_distinct("part").alias("parts")).filter("parts > 1")


def rare_classes(support: DataFrame, least: int) -> DataFrame:
    """Classes whose train support is under `least`."""
    return support.filter(F.col("train") < least)


def funnel(cells: DataFrame, stages: list[tuple[str, Column]], donor: str = "donor_id") -> DataFrame:
    """(stage, cells, donors, dropped): each stage keeps what passed those before; one pass over the cells."""
    passed, aggs = F.lit(True), []
    for i, (_, cond) in enumerate(stages):
        passed = passed & cond
        aggs += [F.count_if(passed).alias(f"c{i}"), F.count_distinct(F.when(passed, F.col(donor))).alias(f"d{i}")]
    one = cells.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.col(f"c{i}").alias("cells"), F.col(f"d{i}").alias("donors")) for i, (name, _) in enumerate(stages))))
    out = one.select(rows.alias("s")).select("s.*")
    return out.withColumn("dropped", F.coalesce(F.lag("cells").over(W.orderBy("step")) - F.col("cells"), F.lit(0)))
