"""Scores of predictions: (node, y, yhat, donor, site, part) rows to per-class, global, per-donor and per-site metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions.scalars import share


def confusion(pred: DataFrame, classes: DataFrame) -> DataFrame:
    """(y, yhat, n) of all pairs of classes, zeros included; as many rows as classes squared."""
    grid = classes.select("y").join(classes.select(F.col("y").alias("yhat")), how="cross")
    n = pred.groupBy("y", "yhat").agg(F.count("*").alias("n"))
    return grid.join(n, ["y", "yhat"], "left").na.fill(0, ["n"])


def per_class(pred: DataFrame, classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every class, in every stratum `by`; 0 / 0 counts as 0."""
    by = by or []
    rows = pred.select(*by, F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("y") == F.col("yhat")).cast("int").alias("h")), F.struct(F.col("yhat").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("s"))
    n = rows.groupBy(*by, F.col("s.c").alias("y")).agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.h").alias("hits"))
    if by:
        grid = pred.select(*by).distinct().crossJoin(F.broadcast(classes.select("y")))  # few classes
    else:
        grid = classes.select("y")
    df = grid.join(n, [*by, "y"], "left").na.fill(0, ["support", "predicted", "hits"])
    df = df.withColumns({"precision": share(F.col("hits"), F.col("predicted")), "recall": share(F.col("hits"), F.col("support")), "f1": share(2 * F.col("hits"), F.col("support") + F.col("predicted"))})
    return df


def summary(classwise: DataFrame, by: list[str] | None = None) -> DataFrame:
    """From per_class: macro and weighted scores, accuracy, balanced accuracy (classes present), F1 over observed classes."""
    seen = F.col("support") > 0
    n = F.sum("support")
    aggs = [F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), share(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"), share(F.sum("hits"), n).alias("accuracy"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"), F.avg(F.when(seen, F.col("f1"))).alias("observed_f1"), n.alias("support"), F.count_if(seen).alias("present")]
    return classwise.groupBy(*by).agg(*aggs) if by else classwise.agg(*aggs)


def observed(pred: DataFrame, by: str) -> DataFrame:
    """(by, observed_macro_f1): over the classes that a stratum's truth has, predictions of others counting as misses."""
    classes = pred.select("y").distinct()
    return summary(per_class(pred, classes, [by]), [by]).select(by, F.col("observed_f1").alias("observed_macro_f1"))


def label_lists(pred: DataFrame, classes: DataFrame, by: str) -> DataFrame:
    """(by, present, absent): sorted classes that a stratum's truth has and lacks."""
    c = per_class(pred, classes, [by])
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("y"))))
    return c.groupBy(by).agg(pick(F.col("support") > 0).alias("present"), pick(F.col("support") == 0).alias("absent"))


def confusion_frame(conf: DataFrame, classes: list[int]) -> DataFrame:
    """One row a true class, a column a predicted one."""
    out = conf.groupBy("y").pivot("yhat", classes).agg(F.sum("n"))
    return out.select(F.concat(F.lit("True_"), F.col("y").cast("string")).alias("label"), *(F.col(f"`{c}`").alias(f"Pred_{c}") for c in classes))


def top_confusions(conf: DataFrame, n: int) -> DataFrame:
    """The n largest mistakes, with their share of the true class."""
    total = conf.groupBy("y").agg(F.sum("n").alias("support"))
    return conf.filter("y <> yhat and n > 0").join(total, "y").withColumn("rate", share(F.col("n"), F.col("support"))).orderBy(F.desc("n"), "y", "yhat").limit(n)
