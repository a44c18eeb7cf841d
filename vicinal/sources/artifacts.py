"""Artifacts of a study as folders: graph bundles with their manifests, the seven files of an audit, and the checklist over both."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators import cells as C
from vicinal.operators import graph as G
from vicinal.session import fresh, written
from vicinal.sources import files

EDGES = "src bigint, dst bigint, dist double"
AUDIT = ("source_manifest", "filtering_funnel", "donor_counts_by_stage", "cell_type_by_donor", "label_support_by_split", "label_policy", "audit_summary")


def write_graph_bundle(edges: DataFrame, nodes: DataFrame, name: str, path: str | None = None, **said: object) -> str:
    """edges, nodes and manifest under path."""
    path = path or fresh(edges.sparkSession, "bundle")
    edges.select("src", "dst", "dist").write.parquet(f"{path}/edges")
    nodes.select("node", "part").write.parquet(f"{path}/nodes")
    G.manifest(edges, nodes, name, **said).coalesce(1).write.json(f"{path}/manifest", ignoreNullFields=False)
    return path


def read_graph_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, manifest)"""
    return spark.read.schema(EDGES).parquet(f"{path}/edges"), spark.read.json(f"{path}/manifest")


def write_audit(cells: DataFrame, counts: DataFrame, split: DataFrame, stages: list[tuple[str, Column]], path: str | None = None, robust: int = 10, donors: int = 12) -> str:
    """What an audit leaves: source_manifest (JSON), filtering_funnel, donor_counts_by_stage, cell_type_by_donor and
    label_support_by_split (CSV), label_policy (JSON: labels that `robust` donors have, and others) and audit_summary (lines of
    Markdown: the checks and their results). Cells pass the stages one after the other; all but the first three files are of cells
    that passed all."""
    spark = cells.sparkSession
    path = path or fresh(spark, "audit")
    passed = F.lit(True)
    for _, cond in stages:
        passed = passed & cond
    cells = written(cells.withColumn("passed", F.coalesce(passed, F.lit(False))), "cells")
    kept = cells.filter("passed").drop("passed")
    parts = kept.join(F.broadcast(split.select("donor_id", "part")), "donor_id")  # a row a donor
    csv = lambda df, name: df.coalesce(1).write.option("header", True).csv(f"{path}/{name}")
    whole = cells.agg(F.count("*").alias("cells"), F.count_distinct("donor_id").alias("donors")).crossJoin(counts.agg(F.count_distinct("gene_id").alias("genes"), F.count_if((F.col("n") < 0) | (F.col("n") % 1 != 0)).alias("bad_counts")))
    whole.withColumn("filters", F.array(*(F.lit(s) for s, _ in stages))).coalesce(1).write.json(f"{path}/source_manifest")
    csv(C.funnel(cells, stages), "filtering_funnel")
    csv(cells.groupBy("donor_id").agg(F.min("site").alias("site"), F.count("*").alias("cells_raw"), F.count_if("passed").alias("cells_kept")), "donor_counts_by_stage")
    csv(kept.groupBy("cell_type", "donor_id").agg(F.count("*").alias("cells")), "cell_type_by_donor")
    csv(parts.groupBy("cell_type", "part").agg(F.count("*").alias("cells")), "label_support_by_split")
    policy = kept.groupBy("cell_type").agg(F.count_distinct("donor_id").alias("donors"), F.count("*").alias("cells"))
    policy.withColumn("status", F.when(F.col("donors") >= robust, "primary").otherwise("deferred")).coalesce(1).write.json(f"{path}/label_policy")
    back = lambda name, kind: spark.read.schema(kind).option("header", True).csv(f"{path}/{name}")
    n = kept.count()
    total = lambda name, kind, col: back(name, kind).agg(F.sum(col).alias("n")).first().n or 0
    checks = {
        "kept cells by donor sum up": total("donor_counts_by_stage", "donor_id string, site string, raw long, kept long", "kept") == n,
        "kept cells by label and donor sum up": total("cell_type_by_donor", "cell_type string, donor_id string, n long", "n") == n,
        "kept cells by part sum up": total("label_support_by_split", "cell_type string, part string, n long", "n") == n,
        "counts are whole and not negative": (whole.first().bad_counts or 0) == 0,
        f"at least {donors} donors": kept.select("donor_id").distinct().count() >= donors,
        "no donor in two parts": C.overlaps(split, "donor_id").limit(1).count() == 0,
    }
    lines = ["# Audit", "", "| check | result |", "|---|---|", *(f"| {k} | {'pass' if v else 'fail'} |" for k, v in checks.items())]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{path}/audit_summary")
    return path


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, name, value): the figures of an audit's files; of the summary, how many checks passed."""
    csv = lambda name, kind: spark.read.schema(kind).option("header", True).csv(f"{path}/{name}")
    row = lambda df, artifact, name, value: df.select(F.lit(artifact).alias("artifact"), name.alias("name"), F.col(value).cast("bigint").alias("value"))
    about = spark.read.json(f"{path}/source_manifest")
    out = row(about, "source_manifest", F.lit("cells"), "cells").unionByName(row(about, "source_manifest", F.lit("genes"), "genes"))
    out = out.unionByName(row(csv("filtering_funnel", "step int, stage string, cells long, donors long, dropped long"), "filtering_funnel", F.col("stage"), "cells"))
    out = out.unionByName(row(csv("donor_counts_by_stage", "donor_id string, site string, raw long, kept long"), "donor_counts_by_stage", F.col("donor_id"), "kept"))
    for name, kind in (("cell_type_by_donor", "donor_id"), ("label_support_by_split", "part")):
        out = out.unionByName(row(csv(name, f"cell_type string, {kind} string, n long"), name, F.concat_ws("|", "cell_type", kind), "n"))
    out = out.unionByName(row(spark.read.schema("cell_type string, donors long, cells long, status string").json(f"{path}/label_policy"), "label_policy", F.col("cell_type"), "donors"))
    passed = spark.read.text(f"{path}/audit_summary").agg(F.count_if(F.col("value").endswith("| pass |")).alias("n"))
    return out.unionByName(row(passed, "audit_summary", F.lit("passed"), "n"))


def _one(spark: SparkSession, kind: str, path: str) -> tuple[int, int, bool]:
    """(rows, rows that break a rule, passed) of an artifact; a missing folder raises."""
    if kind == "split":
        return files.read_split(spark, path).count(), 0, True
    if kind == "features":
        df = spark.read.parquet(path)
        n, bad = df.agg(F.count("*"), F.count_if(F.exists("x", lambda v: v.isNull() | F.isnan(v)))).first()
        return n, bad, bad == 0
    if kind == "graph":
        e, said = read_graph_bundle(spark, path)
        parts = spark.read.schema("node bigint, part string").parquet(f"{path}/nodes")
        got = G.kinds(e, parts).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "disallowed").alias("bad"), G.edge_hash().alias("hash")).first()
        return got.n, got.bad, got.bad == 0 and got.hash == said.first().edge_hash
    if kind == "runs":
        df = files.read_runs(spark, path)
        n, bad = df.agg(F.count("*"), F.count_if(F.col("macro_f1").isNull() | ~F.col("macro_f1").between(0, 1))).first()
        return n, bad, bad == 0
    raise KeyError(f"no check for {kind}")


def validated(spark: SparkSession, home: str, expected: dict[str, list[str]]) -> DataFrame:
    """(category, name, rows, disallowed, passed): the checklist over artifacts at home/category/name. A graph passes if no edge
    goes out from a held-out node and its edges have the manifest's hash; a missing or unreadable artifact doesn't pass, with no
    rows."""
    rows = []
    for kind, names in expected.items():
        for name in names:
            try:
                rows.append((kind, name, *_one(spark, kind, f"{home}/{kind}/{name}")))
            except (AnalysisException, ValueError):
                rows.append((kind, name, 0, 0, False))
    return spark.createDataFrame(rows, "category string, name string, rows long, disallowed long, passed boolean")
