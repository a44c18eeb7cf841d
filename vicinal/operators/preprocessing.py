"""Normalisation, gene selection, scaling and PCA, fitted on training cells only. Counts are sparse: absent rows are zeros."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def log_normalised(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """(cell_id, gene_id, n, norm, v): counts scaled to `target` a cell, and their log1p. A cell without counts has no rows."""
    total = counts.groupBy("cell_id").agg(F.sum("n").alias("total"))
    norm = F.col("n") * (F.lit(target) / F.when(F.col("total") == 0, 1).otherwise(F.col("total")))
    df = counts.join(total, "cell_id").withColumn("norm", norm)
    return df.select("cell_id", "gene_id", "n", "norm", F.log1p("norm").alias("v"))


def gene_moments(values: DataFrame, cells: DataFrame) -> DataFrame:
    """(gene_id, n, mean, sd): over all given cells, absent values as 0; sd is the population's, under 1e-12 it counts as 1."""
    n = cells.agg(F.count("*").alias("cells"))
    s = values.join(cells.select("cell_id"), "cell_id", "left_semi").groupBy("gene_id").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    df = s.crossJoin(F.broadcast(n))  # one row
    mean = F.col("s") / F.col("cells")
    sd = F.sqrt(F.greatest(F.col("ss") / F.col("cells") - mean * mean, F.lit(0.0)))
    return df.select("gene_id", mean.alias("mean"), F.when(sd < 1e-12, 1.0).otherwise(sd).alias("sd"))


def gene_dispersions(values: DataFrame, cells: DataFrame, bins: int = 20) -> DataFrame:
    """(gene_id, mean, dispersion, bin, score): dispersion of normalised values (expm1 of v) against genes of like mean.

    log1p of the mean is cut into equal bins, closed on the right, the lowest also on the left; the score is the z-score of the
    log dispersion in its bin, 1 in a bin of one gene. A gene without dispersion has score null.
    """
    n = cells.agg(F.count("*").alias("cells"))
    e = values.join(cells.select("cell_id"), "cell_id", "left_semi").withColumn("e", F.expm1("v"))
    s = e.groupBy("gene_id").agg(F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("ss")).crossJoin(F.broadcast(n))
    mean = F.when(F.col("s") == 0, 1e-12).otherwise(F.col("s") / F.col("cells"))
    df = s.withColumn("mean", mean).withColumn("var", (F.col("ss") - F.col("cells") * F.col("mean") * F.col("mean")) / (F.col("cells") - 1))
    disp = F.col("var") / F.col("mean")
    df = df.withColumn("dispersion", F.when(disp > 0, F.log(disp))).withColumn("lm", F.log1p("mean"))
    ends = df.agg(F.min("lm").alias("lo"), F.max("lm").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("lm") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))))
    df = df.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.lit(bins), at).cast("int"))
    w = W.partitionBy("bin")
    mu, sd, m = F.avg("dispersion").over(w), F.stddev_samp("dispersion").over(w), F.count("*").over(w)
    score = F.when(m == 1, 1.0).when(sd == 0, 0.0).otherwise((F.col("dispersion") - mu) / sd)
    return df.select("gene_id", "mean", "dispersion", "bin", score.alias("score"))


def variable_genes(values: DataFrame, cells: DataFrame, n: int = 2000, bins: int = 20) -> DataFrame:
    """(gene_id, rank): the n genes of greatest score, ties by name; genes without a score come last."""
    d = gene_dispersions(values, cells, bins)
    return d.orderBy(F.desc_nulls_last("score"), "gene_id").limit(n).select("gene_id", F.row_number().over(W.orderBy(F.desc_nulls_last("score"), "gene_id")).alias("rank"))


def feature_rows(values: DataFrame, cells: DataFrame, stats: DataFrame, clip: float | None = 10.0) -> DataFrame:
    """(cell_id, x): each cell's scaled values in order of genes; absent values become -mean / sd.

    Values stay sparse through the shuffle; a row is made dense where it is used, 256 cells at a time. The genes' list goes to all
    tasks: a number for each selected gene.
    """
    genes = [(r.gene_id, -r["mean"] / r.sd) for r in stats.select("gene_id", "mean", "sd").orderBy("gene_id").collect()]  # the selected genes
    spark = stats.sparkSession
    place = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(genes)], stats.select("gene_id", F.lit(0).alias("i")).schema)
    base = np.array([z for _, z in genes])
    known = stats.join(F.broadcast(place), "gene_id")
    own = values.join(F.broadcast(known), "gene_id").groupBy("cell_id").agg(F.collect_list(F.struct("i", ((F.col("v") - F.col("mean")) / F.col("sd")).alias("z"))).alias("own"))
    rows = cells.select("cell_id").join(own.select("cell_id", F.col("own.i").alias("i"), F.col("own.z").alias("z")), "cell_id", "left")
    low, high = (-np.inf, np.inf) if clip is None else (-clip, clip)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in range(0, whole.num_rows, 256):
                batch = whole.slice(b, 256)
                x = np.tile(base, (batch.num_rows, 1))
                i, z = batch.column("i"), batch.column("z")
                at = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(i), 0).to_numpy(zero_copy_only=False))
                x[at, i.flatten().to_numpy(zero_copy_only=False).astype(int)] = z.flatten().to_numpy(zero_copy_only=False)
                flat = np.clip(x, low, high).reshape(-1)
                yield pa.RecordBatch.from_arrays([batch.column("cell_id"), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(base)), pa.array(flat))], ["cell_id", "x"])

    return rows.mapInArrow(dense, f"cell_id {dict(cells.dtypes)['cell_id']}, x array<double>")


def scaled_totals(values: DataFrame, cells: DataFrame, stats: DataFrame, clip: float | None = 10.0) -> DataFrame:
    """(cell_id, total, genes): each cell's sum of scaled values over all genes of stats. Absent values are the same in every cell: their
    sum is one number, from which a cell's own values depart, so no row is made dense."""
    held = (lambda z: z) if clip is None else (lambda z: F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
    known = stats.select("gene_id", "mean", "sd", held(-F.col("mean") / F.col("sd")).alias("none"))
    own = values.join(known, "gene_id").groupBy("cell_id").agg(F.sum(held((F.col("v") - F.col("mean")) / F.col("sd")) - F.col("none")).alias("own"))
    base = known.agg(F.sum("none").alias("base"), F.count("*").alias("genes"))
    return cells.select("cell_id").join(own, "cell_id", "left").crossJoin(F.broadcast(base)).select("cell_id", (F.coalesce("own", F.lit(0.0)) + F.coalesce("base", F.lit(0.0))).alias("total"), "genes")  # one row


def scaled(values: DataFrame, cells: DataFrame, stats: DataFrame, clip: float | None = 10.0) -> DataFrame:
    """(cell_id, gene_id, z): the long form of feature_rows, every cell by every selected gene; nothing else here needs it."""
    genes = stats.agg(F.array_sort(F.collect_list("gene_id")).alias("genes"))
    rows = feature_rows(values, cells, stats, clip).crossJoin(F.broadcast(genes))  # one row
    return rows.select("cell_id", F.inline(F.arrays_zip(F.col("genes").alias("gene_id"), F.col("x").alias("z")))).toDF("cell_id", "gene_id", "z")


def pca(features: DataFrame, train: DataFrame, k: int = 50):  # noqa: ANN201
    """(model, rows): Spark's PCA fitted on training rows; rows are projected with the training mean taken off, which the model
    itself doesn't do. Features: (cell_id, x)."""
    v = features.withColumn("v", array_to_vector("x"))
    fitted = v.join(train.select("cell_id"), "cell_id", "left_semi")
    width = features.select(F.size("x").alias("n")).first().n
    rows = fitted.count()
    model = PCA(k=max(1, min(k, rows - 1, width)), inputCol="v", outputCol="p").fit(fitted)
    centre = model.transform(fitted).agg(vector_to_array(Summarizer.mean(F.col("p"))).alias("centre"))
    out = model.transform(v).crossJoin(F.broadcast(centre))
    return model, out.select("cell_id", F.zip_with(vector_to_array("p"), "centre", lambda a, b: a - b).alias("pc"))
