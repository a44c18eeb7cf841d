"""Normalisation, gene selection, scaling, PCA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.scalars import r6
from vicinal.operators import preprocessing as P
from vicinal.operators.splitting import donor_split
from vicinal.plans import fixtures as X
from vicinal.queries.registry import CELLS, COUNTS, SPLIT, query, with_
from vicinal.session import written
from vicinal.sources import files

S = SparkSession
VALUES = "tot AS (SELECT cell_id, sum(n) AS t FROM counts GROUP BY 1), vals AS (SELECT cell_id, gene_id, n, n * (10000.0::DOUBLE / t) AS norm, ln(1 + n * (10000.0::DOUBLE / t)) AS v FROM counts JOIN tot USING (cell_id))"
TRAIN = "train AS (SELECT cell_id FROM cells JOIN split USING (donor_id) WHERE part = 'train'), nt AS (SELECT count(*) AS n FROM train)"
STATS = "tv AS (SELECT vals.* FROM vals SEMI JOIN train USING (cell_id)), sums AS (SELECT gene_id, sum(v) AS s, sum(v * v) AS ss, sum(exp(v) - 1) AS e, sum((exp(v) - 1) * (exp(v) - 1)) AS ee FROM tv GROUP BY 1), st AS (SELECT gene_id, s / n AS mean, CASE WHEN sqrt(greatest(ss / n - (s / n) * (s / n), 0)) < 1e-12 THEN 1.0 ELSE sqrt(greatest(ss / n - (s / n) * (s / n), 0)) END AS sd FROM sums, nt)"
HVG = """dis AS (SELECT gene_id, e / n AS mean, ((ee - n * (e / n) * (e / n)) / (n - 1)) / (e / n) AS d, ln(1 + e / n) AS lm FROM sums, nt),
ends AS (SELECT min(lm) AS lo, max(lm) AS hi FROM dis),
bins AS (SELECT gene_id, CASE WHEN d > 0 THEN ln(d) END AS disp, CAST(least(20, greatest(1, ceil((lm - lo) * 20 / (hi - lo)))) AS INT) AS bin FROM dis, ends),
hvg AS (SELECT gene_id, bin, CASE WHEN count(*) OVER w = 1 THEN 1.0 WHEN stddev_samp(disp) OVER w = 0 THEN 0.0 ELSE (disp - avg(disp) OVER w) / stddev_samp(disp) OVER w END AS score FROM bins WINDOW w AS (PARTITION BY bin))"""


def values(spark: S, d: str) -> DataFrame:
    return P.log_normalised(X.counts(spark, d))


def train(spark: S, d: str) -> DataFrame:
    cells = X.cells(spark, d)
    return cells.join(F.broadcast(donor_split(cells).filter("part = 'train'").select("donor_id")), "donor_id", "left_semi").select("cell_id")


@query("pre_libsize", with_(CELLS, COUNTS, VALUES) + "SELECT cell_id, round(sum(norm), 6) AS total, count(*) AS genes FROM vals GROUP BY 1")
def pre_libsize(spark: S, d: str) -> DataFrame:
    return values(spark, d).groupBy("cell_id").agg(r6(F.sum("norm")).alias("total"), F.count("*").alias("genes"))


@query("pre_log1p", with_(CELLS, COUNTS, VALUES) + "SELECT cell_id, gene_id, round(v, 6) AS v FROM vals")
def pre_log1p(spark: S, d: str) -> DataFrame:
    return values(spark, d).select("cell_id", "gene_id", r6("v").alias("v"))


@query("pre_scale_fit", with_(CELLS, COUNTS, VALUES, SPLIT, TRAIN, STATS) + "SELECT gene_id, round(mean, 6) AS mean, round(sd, 6) AS sd FROM st")
def pre_scale_fit(spark: S, d: str) -> DataFrame:
    return P.gene_moments(values(spark, d), train(spark, d)).select("gene_id", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("pre_scale_apply", with_(CELLS, COUNTS, VALUES, SPLIT, TRAIN, STATS) + "SELECT c.cell_id, round(sum(greatest(-10, least(10, (coalesce(v, 0) - mean) / sd))), 4) AS total, count(*) AS genes FROM cells c CROSS JOIN st LEFT JOIN vals ON vals.cell_id = c.cell_id AND vals.gene_id = st.gene_id GROUP BY 1")
def pre_scale_apply(spark: S, d: str) -> DataFrame:
    v = values(spark, d)
    rows = P.scaled_totals(v, X.cells(spark, d), written(P.gene_moments(v, train(spark, d)), "stats"))
    return rows.select("cell_id", F.round("total", 4).alias("total"), "genes")


@query("pre_hvg", with_(CELLS, COUNTS, VALUES, SPLIT, TRAIN, STATS, HVG) + "SELECT gene_id, bin, round(score, 6) AS score FROM hvg")
def pre_hvg(spark: S, d: str) -> DataFrame:
    return P.gene_dispersions(values(spark, d), train(spark, d)).select("gene_id", "bin", r6("score").alias("score"))


@query("topn_hvg", with_(CELLS, COUNTS, VALUES, SPLIT, TRAIN, STATS, HVG) + "SELECT gene_id, row_number() OVER (ORDER BY score DESC NULLS LAST, gene_id) AS rank FROM hvg QUALIFY rank <= 50")
def topn_hvg(spark: S, d: str) -> DataFrame:
    return P.variable_genes(values(spark, d), train(spark, d), 50)


def components(spark: S, d: str):  # noqa: ANN201
    v, t = written(values(spark, d), "values"), train(spark, d)
    genes = P.variable_genes(v, t)
    stats = written(P.gene_moments(v, t).join(F.broadcast(genes.select("gene_id")), "gene_id", "left_semi"), "stats")
    return P.pca(written(P.feature_rows(v, X.cells(spark, d), stats), "features"), written(t, "train"))


@query("pre_pca_fit")
def pre_pca_fit(spark: S, d: str) -> DataFrame:
    """Loadings: one row a gene and component."""
    model, _ = components(spark, d)
    pc = model.pc.toArray()  # once: each access fetches the matrix
    rows = [(j, i, float(pc[i, j])) for j in range(pc.shape[1]) for i in range(pc.shape[0])]
    return spark.createDataFrame(rows, "component int, gene int, loading double")


@query("pre_pca_apply")
def pre_pca_apply(spark: S, d: str) -> DataFrame:
    return components(spark, d)[1]


@query("pre_fit_transform")
def pre_fit_transform(spark: S, d: str) -> DataFrame:
    """(cell_id, part, y, pc): features of all parts, fitted on the training part."""
    from vicinal.operators.cells import label_ids

    cells = X.cells(spark, d)
    parts = cells.join(F.broadcast(donor_split(cells).select("donor_id", "part")), "donor_id")
    return components(spark, d)[1].join(parts, "cell_id").join(F.broadcast(label_ids(cells, "cell_type")), "cell_type").select("cell_id", "part", "y", "pc")


@query("src_bundle", with_(CELLS, COUNTS, SPLIT) + "SELECT part, count(*) AS cells, CAST(sum(n) AS BIGINT) AS total FROM (SELECT cell_id, sum(n) AS n FROM counts GROUP BY 1) JOIN cells USING (cell_id) JOIN split USING (donor_id) GROUP BY 1")
def src_bundle(spark: S, d: str) -> DataFrame:
    cells = X.cells(spark, d)
    rows = X.counts(spark, d).groupBy("cell_id").agg(F.sum("n").alias("n")).join(cells, "cell_id").join(F.broadcast(donor_split(cells).select("donor_id", "part")), "donor_id")
    back = files.read_bundle(spark, files.write_bundle(rows.select("cell_id", "n", "part")), "cell_id bigint, n bigint, part string")
    return back.groupBy("part").agg(F.count("*").alias("cells"), F.sum("n").alias("total"))


@query("chk_shapes", with_(CELLS, SPLIT) + "SELECT part, count(*) AS cells, count(cell_type) AS labels, count(DISTINCT cell_id) AS ids FROM cells JOIN split USING (donor_id) GROUP BY 1")
def chk_shapes(spark: S, d: str) -> DataFrame:
    cells = X.cells(spark, d)
    return cells.join(F.broadcast(donor_split(cells).select("donor_id", "part")), "donor_id").groupBy("part").agg(F.count("*").alias("cells"), F.count("cell_type").alias("labels"), F.count_distinct("cell_id").alias("ids"))
