"""The whole study as one plan: counts to features to graph to scores to gain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators import cells as C
from vicinal.operators import preprocessing as P
from vicinal.operators.evaluation import per_class, summary
from vicinal.operators.graph import pca_knn
from vicinal.operators.models import sweep
from vicinal.operators.splitting import donor_split
from vicinal.session import written


def features(counts: DataFrame, cells: DataFrame, genes: int = 2000, k: int = 50, seed: int = 42) -> DataFrame:
    """nodes (node, x, y, donor, site, part): projections fitted on training cells only. Node ids are cell ids."""
    split = written(donor_split(cells, seed=seed), "split")
    parts = cells.join(split.select("donor_id", "part"), "donor_id")
    train = written(parts.filter("part = 'train'").select("cell_id"), "train")
    values = written(P.log_normalised(counts).select("cell_id", "gene_id", "v"), "values")
    top = P.variable_genes(values, train, genes)
    stats = written(P.gene_moments(values, train).join(top.select("gene_id"), "gene_id", "left_semi"), "stats")
    rows = written(P.feature_rows(values, cells, stats), "features")
    _, pc = P.pca(rows, train, k)
    out = pc.join(parts, "cell_id").join(C.label_ids(cells, "cell_type"), "cell_type")
    return written(out.select(F.col("cell_id").alias("node"), F.col("pc").alias("x"), "y", F.col("donor_id").alias("donor"), "site", "part"), "nodes")


def gain(nodes: DataFrame, k: int = 20, seeds: tuple[int, ...] = (7, 17, 42, 73, 101), **rules: float) -> DataFrame:
    """(model, graph, seed, macro_f1, lift): each graph model against the network without a graph of its seed, on test nodes."""
    graph = written(pca_knn(nodes, k), "edges")
    grid = [(m, g, s) for m, g in (("mlp", "none"), ("gcn", "pca_knn"), ("graphsage", "pca_knn")) for s in seeds]
    p = sweep(nodes, {"pca_knn": graph}, grid, **rules).filter("part = 'test'")
    by = ["model", "graph", "seed"]
    s = summary(per_class(p, nodes.select("y").distinct(), by), by).select(*by, "macro_f1")
    base = s.filter("model = 'mlp'").select("seed", F.col("macro_f1").alias("base"))
    return s.join(base, "seed").select(*by, "macro_f1", (F.col("macro_f1") - F.col("base")).alias("lift"))
