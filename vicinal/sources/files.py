"""Readers and writers of the study's tables, all with fixed schemas; new files go to the session's shared folder."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.schemas import COUNTS, MANIFEST, RUN, schema
from vicinal.session import fresh


def write_counts(counts: DataFrame, path: str | None = None) -> str:
    path = path or fresh(counts.sparkSession, "counts")
    counts.write.parquet(path)
    return path


def read_counts(path: str, spark: SparkSession) -> DataFrame:
    return spark.read.schema(COUNTS).parquet(path)


def write_manifest(manifest: DataFrame, path: str | None = None) -> str:
    path = path or fresh(manifest.sparkSession, "manifest")
    manifest.select(*(F.col(c).cast("string") for c in MANIFEST.names)).write.option("header", True).csv(path)
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Donors and why they are in or out; a missing file is an error, and so is a row that doesn't fit."""
    return spark.read.schema(MANIFEST).option("header", True).option("mode", "FAILFAST").csv(path)


def write_split(split: DataFrame, path: str | None = None) -> str:
    """One JSON document: lists of donors by part, and what the split was made with."""
    path = path or fresh(split.sparkSession, "split")
    pick = lambda p: F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("donor_id").cast("int")))).alias(f"{p}_donors")
    split.agg(F.lit("site_stratified").alias("split_id"), F.lit(42).alias("seed"), pick("train"), pick("val"), pick("test")).coalesce(1).write.json(path)
    return path


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(donor_id, part); a donor in two parts is an error."""
    doc = spark.read.schema(schema("split_id string, seed int, train_donors array<int>, val_donors array<int>, test_donors array<int>")).option("multiLine", True).json(path)
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"{p}_donors").alias("ids")) for p in ("train", "val", "test")))
    rows = doc.select(F.explode(parts).alias("p")).select(F.explode("p.ids").alias("donor_id"), "p.part")
    twice = rows.groupBy("donor_id").agg(F.count_distinct("part").alias("n")).filter("n > 1").limit(1).count()
    if twice:
        raise ValueError("a donor is in more than one part")
    return rows


def write_runs(runs: DataFrame, path: str | None = None) -> str:
    path = path or fresh(runs.sparkSession, "runs")
    runs.write.json(path)
    return path


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a results tree; records that can't be parsed are left out, and a run id that stands twice counts once."""
    kind = type(RUN)([*RUN.fields]).add("_corrupt_record", "string")
    df = spark.read.schema(kind).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    return df.filter(F.col("run_id").isNotNull()).drop("_corrupt_record").dropDuplicates(["run_id"])


def write_bundle(features: DataFrame, path: str | None = None) -> str:
    """Feature rows by part."""
    path = path or fresh(features.sparkSession, "bundle")
    features.write.partitionBy("part").parquet(path)
    return path


def read_bundle(spark: SparkSession, path: str, columns: str, part: str | None = None) -> DataFrame:
    """All parts, or one, of which only that folder is read. columns: DDL of the rows."""
    df = spark.read.schema(columns).parquet(path)
    return df.filter(F.col("part") == part) if part else df


def write_graph(edges: DataFrame, path: str | None = None) -> str:
    """Edges by kind."""
    path = path or fresh(edges.sparkSession, "graph")
    edges.write.partitionBy("kind").parquet(path)
    return path


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src bigint, dst bigint, dist double, kind string").parquet(path)


def write_table(df: DataFrame, kind: str, path: str | None = None) -> str:
    """A result as CSV with a header, JSON records or Parquet; an empty table gives an empty folder with its schema."""
    path = path or fresh(df.sparkSession, "table")
    {"csv": lambda w: w.option("header", True).csv, "json": lambda w: w.json, "parquet": lambda w: w.parquet}[kind](df.write)(path)
    return path


def synthetic_counts(cells: DataFrame, genes: int = 60, classes: int = 5, seed: int = 42) -> DataFrame:
    """(cell_id, donor_id, cell_type, gene_id, n): seeded counts for each of the given cells (cell_id, donor_id, cell_type), with marker
    genes of each type. A count follows from MD5 of seed, cell and gene, so rows grow with the cells and are the same anywhere."""
    code = lambda text, digits: F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")
    each = cells.select("cell_id", "donor_id", "cell_type", F.explode(F.sequence(F.lit(0), F.lit(genes - 1))).alias("g"))
    u = code(F.concat_ws(":", F.lit(str(seed)), F.col("cell_id").cast("string"), F.col("g").cast("string")), 8) / F.lit(2.0**32) + F.lit(2.0**-33)
    rate = F.when(F.pmod("g", F.lit(classes)) == F.pmod(code(F.col("cell_type"), 4), F.lit(classes)), 3.2).otherwise(0.8)
    rows = each.select("cell_id", "donor_id", "cell_type", F.concat(F.lit("gene_"), F.col("g").cast("string")).alias("gene_id"), F.floor(-F.log(u) * rate).cast("bigint").alias("n"))
    return rows.filter("n > 0")


def synthetic(spark: SparkSession, cells: int = 200, genes: int = 60, donors: int = 6, classes: int = 4, seed: int = 42) -> DataFrame:
    """The same for cells numbered from 0, dealt to donors in turn and to types by hash; a table for tests."""
    kind = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:type:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(classes))
    made = spark.range(cells).select(F.col("id").alias("cell_id"), F.pmod("id", F.lit(donors)).cast("int").alias("donor_id"), F.concat(F.lit("type_"), kind.cast("string")).alias("cell_type"))
    return synthetic_counts(made, genes, classes, seed)


SOURCES: dict[str, object] = {}


def register_source(name: str):  # noqa: ANN201
    """A reader (spark, dir) -> DataFrame under a name that can be taken once."""

    def add(f):  # noqa: ANN001, ANN202
        if name in SOURCES:
            raise ValueError(f"a source {name} is there already")
        SOURCES[name] = f
        return f

    return add


def source(name: str):  # noqa: ANN201
    if name not in SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


def list_sources() -> list[str]:
    return sorted(SOURCES)


register_source("synthetic")(lambda spark, d: synthetic(spark))
register_source("counts")(lambda spark, d: read_counts(d, spark))
