"""Runs as tables: tidy metrics, the matched join of runs with their baseline, and the gain of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.schemas import MATCH_KEYS

BASELINES = ("mlp", "logistic_regression", "centroid")


def tidy(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metrics to (keys, metric_name, metric_value) rows; a null value (a failed run) stays a row."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value")) for m in metrics))
    return df.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.metric_name", "m.metric_value")


def matched(runs: DataFrame, baseline: str, strict: bool = False) -> DataFrame:
    """Each graph run beside the baseline of its seed: status, the keys that differ, and the lifts where it matches.

    strict: a mismatch fails the query, naming the keys; otherwise such rows stay with status mismatched or unmatched and
    null lifts. Repeated baselines of a seed count once, the one of least run id.
    """
    base = runs.filter(F.col("model") == baseline).groupBy("seed").agg(F.min_by(F.struct(*runs.columns), "run_id").alias("b"))
    df = runs.filter(~F.col("model").isin(*BASELINES)).join(base, "seed", "left")
    differ = F.filter(F.array(*(F.when(~F.col(k).eqNullSafe(F.col(f"b.{k}")), F.lit(k)) for k in MATCH_KEYS)), lambda x: x.isNotNull())
    df = df.withColumn("differ", F.when(F.col("b").isNotNull(), F.array_join(differ, ",")).otherwise(""))
    status = F.when(F.col("b").isNull(), "unmatched").when(F.col("differ") != "", "mismatched").otherwise("matched")
    if strict:
        status = F.when(F.col("differ") != "", F.raise_error(F.concat(F.lit("runs differ in "), F.col("differ")))).otherwise(status)
    df = df.withColumn("match_status", status)
    ok = F.col("match_status") == "matched"
    return df.select("run_id", "model", "graph", "seed", "match_status", "differ", F.col("b.run_id").alias("baseline_run_id"), F.when(ok, F.col("macro_f1") - F.col("b.macro_f1")).alias("lift_macro_f1"), F.when(ok, F.col("balanced_accuracy") - F.col("b.balanced_accuracy")).alias("lift_balanced_accuracy"))


def strata_lifts(strata: DataFrame, lifts: DataFrame, key: str) -> DataFrame:
    """(run_id, key, lift): strata (run_id, key, value) of matched runs less those of their baseline, where both have the stratum."""
    pairs = lifts.filter("match_status = 'matched'").select("run_id", "baseline_run_id")
    b = strata.select(F.col("run_id").alias("baseline_run_id"), key, F.col("value").alias("base"))
    return strata.join(pairs, "run_id").join(b, ["baseline_run_id", key]).select("run_id", key, (F.col("value") - F.col("base")).alias("lift"))


def seed_summary(lifts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over runs; 0 for one run."""
    return lifts.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
