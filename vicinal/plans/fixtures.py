"""The study's tables as stand-ins on the driver's tables: customers are cells, nations donors, regions sites, vectors nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators.graph import knn_train, knn_query, pca_knn


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("donor_id"), F.col("n_regionkey").alias("site"), F.col("c_mktsegment").alias("cell_type"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    li, o, p = read(spark, d, "lineitem"), read(spark, d, "orders"), read(spark, d, "part")
    df = li.select("l_orderkey", "l_partkey", "l_quantity").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(p.select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("gene_id")), F.col("l_partkey") == F.col("p_partkey"))
    return df.groupBy(F.col("o_custkey").alias("cell_id"), "gene_id").agg(F.sum("l_quantity").cast("bigint").alias("n"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    donor = F.pmod("vec_id", F.lit(23))
    part = F.when(donor.isin(*range(6), *range(12, 18)), "train").when(donor.isin(6, 7, 8, 18, 19, 20), "val").otherwise("test")
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"), donor.alias("donor"), F.when(donor < 12, "Cambridge").otherwise("Newcastle").alias("site"), part.alias("part"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Nations as donors: those of region 4 are left out, as are names that start with I."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = (F.col("n_regionkey") == 4) | F.col("n_name").startswith("I")
    return n.select(F.col("n_nationkey").alias("donor_id"), F.col("r_name").alias("site"), F.lit("normal").alias("disease_status"), F.when(F.col("n_name").startswith("I"), "perturbed").otherwise("none").alias("perturbation_status"), F.when(out, "excluded").otherwise("included").alias("inclusion_status"), F.when(out, "rule").otherwise("").alias("exclusion_rationale"))


def nearest_centroid(nodes_: DataFrame) -> DataFrame:
    """(node, yhat): the label of the nearest mean of training nodes; ties to the least label."""
    c = nodes_.filter("part = 'train'").select("y", F.posexplode("x").alias("i", "v")).groupBy("y", "i").agg(F.avg("v").alias("v")).groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c"))
    pairs = nodes_.select("node", "x").crossJoin(F.broadcast(c))  # one row a class
    dist = F.sqrt(F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return pairs.groupBy("node").agg(F.min_by("y", F.struct(F.round(dist, 9), "y")).alias("yhat"))


def majority_vote(edges: DataFrame, nodes_: DataFrame) -> DataFrame:
    """(node, yhat): the commonest label among a node's sources; ties to the least label; -1 without any."""
    n = edges.join(nodes_.select(F.col("node").alias("src"), "y"), "src").groupBy(F.col("dst").alias("node"), "y").agg(F.count("*").alias("n"))
    best = n.groupBy("node").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("yhat"))
    return nodes_.select("node").join(best, "node", "left").na.fill(-1, ["yhat"])


def predictions(spark: SparkSession, d: str, kind: str = "centroid") -> DataFrame:
    n = nodes(spark, d)
    yhat = nearest_centroid(n) if kind == "centroid" else majority_vote(pca_knn(n, 20), n)
    return n.select("node", "y", "donor", "site", "part").join(yhat, "node")


def train_knn(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return knn_train(nodes(spark, d), k)


def query_knn(spark: SparkSession, d: str, k: int = 20, part: str | None = None) -> DataFrame:
    return knn_query(nodes(spark, d), k, part)


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic runs: a baseline for each of three seeds, two graphs; one graph run has another feature hash, one no baseline.

    Scores are shares of orders, so they follow the tables.
    """
    o = read(spark, d, "orders").groupBy(F.pmod("o_orderkey", F.lit(12)).alias("m")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("k"))
    score = o.withColumn("macro_f1", F.round(F.col("k") / F.col("n"), 6)).withColumn("balanced_accuracy", F.round(F.col("k") / (F.col("n") + F.col("m")), 6))
    seed = F.element_at(F.array(F.lit(7), F.lit(17), F.lit(42), F.lit(73)), (F.pmod("m", F.lit(4)) + 1).cast("int"))
    model = F.when(F.col("m") < 3, "mlp").when(F.col("m") < 8, "gcn").otherwise("graphsage")
    graph = F.when(F.col("m") < 3, "none").when(F.pmod("m", F.lit(2)) == 0, "pca_knn_k20").otherwise("bbknn")
    return score.select(F.concat(F.lit("run"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("run_id"), model.alias("model"), graph.alias("graph"), seed.alias("seed"), F.lit("ds").alias("dataset"), F.lit("v1").alias("dataset_version"), F.lit("s42").alias("split_id"), F.lit("h1").alias("split_hash"), F.when(F.col("m") == 5, "other").otherwise("f1").alias("feature_hash"), F.lit("p1").alias("preprocessing_hash"), F.lit("l1").alias("label_hash"), F.lit("success").alias("status"), "macro_f1", "balanced_accuracy")
