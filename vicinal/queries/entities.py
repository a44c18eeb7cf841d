"""Sources, filters, projections, checks, counts, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.functions.scalars import canon_label, r6
from vicinal.operators import cells as C
from vicinal.operators import graph as G
from vicinal.operators.splitting import donor_split, random_split
from vicinal.plans import fixtures as X
from vicinal.queries.registry import CELLS, COUNTS, MANIFEST, NODES, RUNS, SPLIT, content_sql, edges, knn, query, with_
from vicinal.session import fresh, written
from vicinal.sources import artifacts, files
from vicinal.sources.run_store import registered

S = SparkSession
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def split(spark: S, d: str) -> DataFrame:
    return donor_split(X.cells(spark, d))


def cell_parts(spark: S, d: str) -> DataFrame:
    return X.cells(spark, d).join(F.broadcast(split(spark, d).select("donor_id", "part")), "donor_id")  # a row a nation


@query("src_h5ad", with_(CELLS, COUNTS) + "SELECT count(*) AS nonzeros, CAST(sum(n) AS BIGINT) AS total, (SELECT count(*) FROM cells) AS cells FROM counts")
def src_h5ad(spark: S, d: str) -> DataFrame:
    n = X.cells(spark, d).agg(F.count("*").alias("cells"))
    return files.read_counts(files.write_counts(X.counts(spark, d)), spark).agg(F.count("*").alias("nonzeros"), F.sum("n").alias("total")).crossJoin(n)


@query("src_manifest", with_(MANIFEST) + "SELECT CAST(donor_id AS VARCHAR) AS donor_id, site, inclusion_status, perturbation_status FROM manifest")
def src_manifest(spark: S, d: str) -> DataFrame:
    return files.read_manifest(spark, files.write_manifest(X.manifest(spark, d))).select("donor_id", "site", "inclusion_status", "perturbation_status")


@query("src_split", with_(CELLS, SPLIT) + "SELECT donor_id, part FROM split")
def src_split(spark: S, d: str) -> DataFrame:
    return files.read_split(spark, files.write_split(split(spark, d)))


@query("src_run_store", with_(RUNS) + "SELECT run_id, model, graph, seed, feature_hash, macro_f1, balanced_accuracy FROM runs WHERE run_id IN ('run03', 'run04', 'run05', 'run09')")
def src_run_store(spark: S, d: str) -> DataFrame:
    """Runs written to a run store and some of them read back: the filter reaches the store."""
    entries = lambda *names: F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("string"))))
    root = fresh(registered(spark), "runs")
    scores = F.create_map(*(x for n in ("macro_f1", "balanced_accuracy") for x in (F.lit(n), F.col(n))))
    X.runs(spark, d).select("run_id", "status", entries("model", "graph", "seed").alias("params"), scores.alias("metrics"), entries("feature_hash").alias("tags")).write.format("runs").mode("append").save(root)
    some = spark.read.format("runs").load(root).filter(F.col("run_id").isin("run03", "run04", "run05", "run09") & (F.col("status") == "success"))
    of = lambda c, n: F.col(c)[n].alias(n)
    return some.select("run_id", of("params", "model"), of("params", "graph"), F.col("params")["seed"].cast("int").alias("seed"), of("tags", "feature_hash"), of("metrics", "macro_f1"), of("metrics", "balanced_accuracy"))


@query("src_runs", with_(RUNS) + "SELECT run_id, model, graph, seed, macro_f1 FROM runs")
def src_runs(spark: S, d: str) -> DataFrame:
    return files.read_runs(spark, files.write_runs(X.runs(spark, d))).select("run_id", "model", "graph", "seed", "macro_f1")


_SYNTH = """, gene AS (SELECT unnest(range(60)) AS g),
raw AS (SELECT cell_id, donor_id, cell_type, g, CAST('0x' || substr(md5('42:' || cell_id || ':' || g), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE + 0.5::DOUBLE / 4294967296.0::DOUBLE AS u,
  CASE WHEN g % 5 = CAST('0x' || substr(md5(cell_type), 1, 4) AS BIGINT) % 5 THEN 3.2::DOUBLE ELSE 0.8::DOUBLE END AS rate FROM cells, gene),
made AS (SELECT cell_id, donor_id, cell_type, 'gene_' || g AS gene_id, CAST(floor(-ln(u) * rate) AS BIGINT) AS n FROM raw)
SELECT * FROM made WHERE n > 0"""


@query("src_synth", with_(CELLS) + _SYNTH)
def src_synth(spark: S, d: str) -> DataFrame:
    return files.synthetic_counts(X.cells(spark, d))


@query("flt_donor_included", with_(CELLS, MANIFEST) + "SELECT cell_id, donor_id FROM cells SEMI JOIN (SELECT * FROM manifest WHERE inclusion_status = 'included') USING (donor_id)")
def flt_donor_included(spark: S, d: str) -> DataFrame:
    return C.included(X.cells(spark, d), X.manifest(spark, d)).select("cell_id", "donor_id")


@query("prj_site_lookup", with_(CELLS, MANIFEST) + "SELECT cell_id, m.site FROM cells c LEFT JOIN manifest m USING (donor_id)")
def prj_site_lookup(spark: S, d: str) -> DataFrame:
    return C.with_site(X.cells(spark, d), X.manifest(spark, d)).select("cell_id", "site")


@query("join_donor_site", with_(CELLS, MANIFEST) + "SELECT m.site, count(*) AS n FROM cells c LEFT JOIN manifest m USING (donor_id) GROUP BY 1")
def join_donor_site(spark: S, d: str) -> DataFrame:
    return C.with_site(X.cells(spark, d), X.manifest(spark, d)).groupBy("site").agg(F.count("*").alias("n"))


@query("prj_cell_id", with_(CELLS) + "SELECT 'c' || cell_id AS cell_id FROM cells")
def prj_cell_id(spark: S, d: str) -> DataFrame:
    return X.cells(spark, d).select(F.concat(F.lit("c"), F.col("cell_id").cast("string")).alias("cell_id"))


@query("flt_label_policy", with_(CELLS) + "SELECT cell_id, cell_type IN ('BUILDING', 'MACHINERY') AS is_primary FROM cells")
def flt_label_policy(spark: S, d: str) -> DataFrame:
    return X.cells(spark, d).select("cell_id", F.col("cell_type").isin("BUILDING", "MACHINERY").alias("is_primary"))


@query("flt_prefix", "SELECT n_nationkey AS donor_id, n_name FROM nation WHERE n_name NOT LIKE 'I%'")
def flt_prefix(spark: S, d: str) -> DataFrame:
    return X.read(spark, d, "nation").filter(~F.col("n_name").startswith("I")).select(F.col("n_nationkey").alias("donor_id"), "n_name")


@query("flt_annotated", with_(CELLS) + "SELECT cell_id, cell_type FROM cells WHERE cell_type IS NOT NULL AND cell_type NOT IN ('HOUSEHOLD')")
def flt_annotated(spark: S, d: str) -> DataFrame:
    return C.annotated(X.cells(spark, d), "cell_type", ["HOUSEHOLD"]).select("cell_id", "cell_type")


@query("flt_eq", with_(CELLS) + "SELECT cell_id FROM cells WHERE site = 1")
def flt_eq(spark: S, d: str) -> DataFrame:
    return X.cells(spark, d).filter("site = 1").select("cell_id")


@query("flt_min_group", with_(CELLS) + "SELECT cell_id, donor_id FROM cells WHERE donor_id IN (SELECT donor_id FROM cells GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 25 FROM cells))")
def flt_min_group(spark: S, d: str) -> DataFrame:
    cells = X.cells(spark, d)
    large = cells.groupBy("donor_id").agg(F.count("*").alias("n")).crossJoin(cells.agg((F.count("*") / 25).alias("least"))).filter("n >= least")
    return cells.join(large, "donor_id", "left_semi").select("cell_id", "donor_id")


ALIASES = {"building": "construction", "machinery": "construction", "furniture": "home", "household": "home"}


@query("prj_canon_label", with_(CELLS) + "SELECT cell_id, coalesce(MAP {'building': 'construction', 'machinery': 'construction', 'furniture': 'home', 'household': 'home'}[lower(trim(cell_type))], cell_type) AS label FROM cells")
def prj_canon_label(spark: S, d: str) -> DataFrame:
    return X.cells(spark, d).select("cell_id", canon_label(F.col("cell_type"), ALIASES).alias("label"))


@query("smp_per_group", with_(CELLS) + "SELECT cell_id, donor_id FROM (SELECT *, row_number() OVER (PARTITION BY donor_id ORDER BY md5('42|' || cell_id), cell_id) AS r FROM cells) WHERE r <= 20")
def smp_per_group(spark: S, d: str) -> DataFrame:
    return C.capped(X.cells(spark, d), "donor_id", 20, 42, "cell_id").select("cell_id", "donor_id")


@query("prj_label_encode", with_(CELLS) + "SELECT cell_id, CAST(dense_rank() OVER (ORDER BY cell_type) - 1 AS INT) AS y FROM cells")
def prj_label_encode(spark: S, d: str) -> DataFrame:
    cells = X.cells(spark, d)
    return cells.join(F.broadcast(C.label_ids(cells, "cell_type")), "cell_type").select("cell_id", "y")  # a row a class


@query("prj_label_decode", with_(CELLS) + "SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY cell_type) - 1 AS INT) AS y, cell_type FROM cells")
def prj_label_decode(spark: S, d: str) -> DataFrame:
    return C.label_ids(X.cells(spark, d), "cell_type").select("y", "cell_type")


@query("flt_runs", with_(RUNS) + "SELECT run_id, model FROM runs WHERE graph IN ('bbknn') AND regexp_matches(run_id, '^run(0|1)[0-9]$') AND seed IN (7, 17, 42, 73)")
def flt_runs(spark: S, d: str) -> DataFrame:
    return X.runs(spark, d).filter(F.col("graph").isin("bbknn") & F.col("run_id").rlike("^run(0|1)[0-9]$") & F.col("seed").isin(7, 17, 42, 73)).select("run_id", "model")


#: Sound tables and ones with planted defects: each 50th cell twice, the copy without a label; counts of each 41st cell negative.
FLAWED = CELLS + ", " + COUNTS + """,
fc AS (SELECT * FROM cells UNION ALL SELECT cell_id, donor_id, site, NULL FROM cells WHERE cell_id % 50 = 0),
fn AS (SELECT cell_id, CASE WHEN cell_id % 41 = 0 THEN -n ELSE n END AS n FROM counts)"""
#: What each check counts, and of which tables; donors with fewer cells than this break min_cells.
LEAST = 8
_BROKEN = {
    "nonempty": "SELECT 1 - count(*) FROM (SELECT 1 FROM {cells} WHERE {some} LIMIT 1)",
    "unique_id": "SELECT count(*) FROM (SELECT cell_id FROM {cells} WHERE {some} GROUP BY 1 HAVING count(*) > 1)",
    "nulls": "SELECT count(*) FROM {cells} WHERE {some} AND (donor_id IS NULL OR cell_type IS NULL)",
    "counts": "SELECT count(*) FROM {counts} WHERE {some} AND (n < 0 OR n % 1 <> 0)",
    "min_cells": "SELECT count(*) FROM (SELECT donor_id FROM {cells} WHERE {some} GROUP BY 1 HAVING count(*) < " + str(LEAST) + ")",
}


def flawed(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    c, n = X.cells(spark, d), X.counts(spark, d)
    twice = c.filter("cell_id % 50 = 0").withColumn("cell_type", F.lit(None).cast("string"))
    return c.unionByName(twice), n.withColumn("n", F.when(F.col("cell_id") % 41 == 0, -F.col("n")).otherwise(F.col("n")))


def _check(name: str) -> None:
    one = lambda table, cells, counts, some: f"SELECT '{table}' AS \"table\", '{name}' AS \"check\", CAST((" + _BROKEN[name].format(cells=cells, counts=counts, some=some) + ") AS BIGINT) AS bad"

    @query(f"chk_{name}", with_(FLAWED) + " UNION ALL ".join((one("sound", "cells", "counts", "true"), one("flawed", "fc", "fn", "true"), one("empty", "fc", "fn", "cell_id < 0"))))
    def run(spark: S, d: str) -> DataFrame:
        """The check's count on sound tables, on ones with planted defects, and on empty ones."""
        bad = flawed(spark, d)
        tables = {"sound": (X.cells(spark, d), X.counts(spark, d)), "flawed": bad, "empty": tuple(t.filter("cell_id < 0") for t in bad)}
        out = None
        for table, (c, n) in tables.items():
            one = C.violations(c, n, least=LEAST).filter(F.col("check") == name).select(F.lit(table).alias("table"), "check", F.col("bad").cast("bigint").alias("bad"))
            out = one if out is None else out.unionByName(one)
        return out


for _name in _BROKEN:
    _check(_name)


@query("chk_disjoint", with_(CELLS, SPLIT) + "SELECT (SELECT count(*) FROM (SELECT donor_id FROM split GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS donors, (SELECT count(*) FROM (SELECT cell_id FROM cells JOIN split USING (donor_id) GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS cells")
def chk_disjoint(spark: S, d: str) -> DataFrame:
    a = C.overlaps(split(spark, d), "donor_id").agg(F.count("*").alias("donors"))
    return a.crossJoin(C.overlaps(cell_parts(spark, d), "cell_id").agg(F.count("*").alias("cells")))


@query("chk_reconcile", with_(CELLS) + "SELECT count(*) AS cells, CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM cells GROUP BY donor_id)) AS BIGINT) AS by_donor, CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM cells GROUP BY cell_type, donor_id)) AS BIGINT) AS by_pair FROM cells")
def chk_reconcile(spark: S, d: str) -> DataFrame:
    c = X.cells(spark, d)
    return c.agg(F.count("*").alias("cells")).crossJoin(c.groupBy("donor_id").count().agg(F.sum("count").alias("by_donor"))).crossJoin(c.groupBy("cell_type", "donor_id").count().agg(F.sum("count").alias("by_pair")))


_SUPPORT = "support AS (SELECT cell_type, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'val') AS val, count(*) FILTER (part = 'test') AS test, count(*) AS total FROM cells JOIN split USING (donor_id) GROUP BY 1)"


def support(spark: S, d: str) -> DataFrame:
    return C.crosstab(cell_parts(spark, d), "cell_type", "part", ["train", "val", "test"])


@query("agg_crosstab", with_(CELLS, SPLIT, _SUPPORT) + "SELECT * FROM support")
def agg_crosstab(spark: S, d: str) -> DataFrame:
    return support(spark, d)


@query("split_label_support", with_(CELLS, SPLIT, _SUPPORT) + "SELECT cell_type, train, val, test FROM support")
def split_label_support(spark: S, d: str) -> DataFrame:
    return support(spark, d).drop("total")


@query("chk_rare_class", with_(CELLS, SPLIT, _SUPPORT) + "SELECT cell_type, train FROM support WHERE train < (SELECT avg(train) FROM support)")
def chk_rare_class(spark: S, d: str) -> DataFrame:
    s = support(spark, d)
    return s.crossJoin(s.agg(F.avg("train").alias("least"))).filter("train < least").select("cell_type", "train")


@query("trk_label_support", with_(CELLS, SPLIT, _SUPPORT) + "SELECT cell_type, CASE WHEN test = 0 THEN 'unsupported' WHEN test < 20 THEN 'low_support' ELSE 'evaluated' END AS status FROM support")
def trk_label_support(spark: S, d: str) -> DataFrame:
    return support(spark, d).select("cell_type", F.when(F.col("test") == 0, "unsupported").when(F.col("test") < 20, "low_support").otherwise("evaluated").alias("status"))


@query("agg_crosstab_margins", with_(CELLS) + "SELECT CASE WHEN grouping(cell_type) = 1 THEN 'Total' ELSE cell_type END AS cell_type, CASE WHEN grouping(donor_id) = 1 THEN 'Total' ELSE CAST(donor_id AS VARCHAR) END AS donor_id, count(*) AS n FROM cells GROUP BY CUBE (cell_type, donor_id)")
def agg_crosstab_margins(spark: S, d: str) -> DataFrame:
    return C.margins(X.cells(spark, d), "cell_type", "donor_id")


@query("agg_value_counts", with_(CELLS) + "SELECT donor_id, count(*) AS n FROM cells GROUP BY 1")
def agg_value_counts(spark: S, d: str) -> DataFrame:
    return X.cells(spark, d).groupBy("donor_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "donor_id")


@query("agg_group_first", with_(CELLS) + "SELECT donor_id, min(site) AS site, count(DISTINCT site) AS sites FROM cells GROUP BY 1")
def agg_group_first(spark: S, d: str) -> DataFrame:
    return X.cells(spark, d).groupBy("donor_id").agg(F.min("site").alias("site"), F.count_distinct("site").alias("sites"))


@query("agg_nunique", with_(CELLS) + "SELECT count(DISTINCT donor_id) AS donors, count(DISTINCT cell_type) AS labels FROM cells")
def agg_nunique(spark: S, d: str) -> DataFrame:
    return X.cells(spark, d).agg(F.count_distinct("donor_id").alias("donors"), F.count_distinct("cell_type").alias("labels"))


@query("agg_presence", with_(CELLS) + "SELECT cell_type, donors, CASE WHEN donors >= 10 THEN 'primary' WHEN donors >= 4 THEN 'deferred' ELSE 'rest' END AS band FROM (SELECT cell_type, count(*) FILTER (n >= 5) AS donors FROM (SELECT cell_type, donor_id, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1)")
def agg_presence(spark: S, d: str) -> DataFrame:
    n = X.cells(spark, d).groupBy("cell_type", "donor_id").agg(F.count("*").alias("n")).groupBy("cell_type").agg(F.count_if(F.col("n") >= 5).alias("donors"))
    return n.withColumn("band", F.when(F.col("donors") >= 10, "primary").when(F.col("donors") >= 4, "deferred").otherwise("rest"))




@query("agg_funnel", with_(CELLS) + """, s AS (SELECT 0 AS step, 'raw' AS stage, * FROM cells UNION ALL SELECT 1, 'site', * FROM cells WHERE site <> 4 UNION ALL SELECT 2, 'label', * FROM cells WHERE site <> 4 AND cell_type <> 'HOUSEHOLD'),
f AS (SELECT step, stage, count(*) AS cells, count(DISTINCT donor_id) AS donors FROM s GROUP BY 1, 2)
SELECT *, coalesce(lag(cells) OVER (ORDER BY step) - cells, 0) AS dropped FROM f""")
def agg_funnel(spark: S, d: str) -> DataFrame:
    return C.funnel(X.cells(spark, d), [("raw", F.lit(True)), ("site", F.col("site") != 4), ("label", F.col("cell_type") != "HOUSEHOLD")])


@query("agg_donor_stages", with_(CELLS) + "SELECT donor_id, count(*) AS cells, count(*) FILTER (cell_type <> 'HOUSEHOLD') AS labelled, CASE WHEN any_value(site) = 4 THEN 'excluded' ELSE 'included' END AS status FROM cells GROUP BY 1")
def agg_donor_stages(spark: S, d: str) -> DataFrame:
    return X.cells(spark, d).groupBy("donor_id").agg(F.count("*").alias("cells"), F.count_if(F.col("cell_type") != "HOUSEHOLD").alias("labelled"), F.when(F.max("site") == 4, "excluded").otherwise("included").alias("status"))


@query("agg_site_composition", with_(CELLS, SPLIT) + "SELECT part, site, count(*) AS donors FROM split GROUP BY 1, 2")
def agg_site_composition(spark: S, d: str) -> DataFrame:
    return split(spark, d).groupBy("part", "site").agg(F.count("*").alias("donors"))


@query("agg_summary", with_(COUNTS) + "SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n) AS median, round(stddev_pop(n), 6) AS sd FROM counts")
def agg_summary(spark: S, d: str) -> DataFrame:
    return X.counts(spark, d).agg(F.min("n").alias("least"), F.max("n").alias("most"), r6(F.avg("n")).alias("mean"), F.median("n").alias("median"), r6(F.stddev_pop("n")).alias("sd"))


@query("join_id_lookup", with_(CELLS, COUNTS) + "SELECT cell_id, cell_type, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM cells LEFT JOIN counts USING (cell_id) GROUP BY 1, 2")
def join_id_lookup(spark: S, d: str) -> DataFrame:
    total = X.counts(spark, d).groupBy("cell_id").agg(F.sum("n").alias("total"))
    return X.cells(spark, d).join(total, "cell_id", "left").select("cell_id", "cell_type", F.coalesce("total", F.lit(0)).alias("total"))


@query("win_donor_rank", with_(CELLS) + "SELECT donor_id, site, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, donor_id) AS r FROM (SELECT donor_id, min(site) AS site, count(*) AS n FROM cells GROUP BY 1)")
def win_donor_rank(spark: S, d: str) -> DataFrame:
    n = X.cells(spark, d).groupBy("donor_id").agg(F.min("site").alias("site"), F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("site").orderBy(F.desc("n"), "donor_id")))


@query("win_audit_mod4", with_(CELLS) + "SELECT donor_id, n, CASE WHEN r % 4 < 2 THEN 'train' WHEN r % 4 = 2 THEN 'val' ELSE 'test' END AS part FROM (SELECT donor_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, donor_id) - 1 AS r FROM cells GROUP BY 1)")
def win_audit_mod4(spark: S, d: str) -> DataFrame:
    n = X.cells(spark, d).groupBy("donor_id").agg(F.count("*").alias("n"))
    r = F.pmod(F.row_number().over(W.orderBy(F.desc("n"), "donor_id")) - 1, F.lit(4))
    return n.withColumn("r", r).select("donor_id", "n", F.when(F.col("r") < 2, "train").when(F.col("r") == 2, "val").otherwise("test").alias("part"))


@query("sort_unique", with_(CELLS) + "SELECT DISTINCT cell_type FROM cells")
def sort_unique(spark: S, d: str) -> DataFrame:
    return X.cells(spark, d).select("cell_type").distinct().orderBy("cell_type")


@query("set_intersect", with_(CELLS) + "SELECT cell_type FROM cells WHERE site = 0 INTERSECT SELECT cell_type FROM cells WHERE site = 1")
def set_intersect(spark: S, d: str) -> DataFrame:
    c = X.cells(spark, d)
    return c.filter("site = 0").select("cell_type").intersect(c.filter("site = 1").select("cell_type"))


@query("set_except", with_(CELLS) + "SELECT DISTINCT cell_type FROM cells EXCEPT SELECT unnest(['BUILDING', 'MACHINERY'])")
def set_except(spark: S, d: str) -> DataFrame:
    policy = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "cell_type string")
    return X.cells(spark, d).select("cell_type").distinct().join(F.broadcast(policy), "cell_type", "left_anti")


@query("split_donor_site", with_(CELLS, SPLIT) + "SELECT * FROM split")
def split_donor_site(spark: S, d: str) -> DataFrame:
    return split(spark, d)


@query("split_random_debug", with_(CELLS) + ", r AS (SELECT cell_id, row_number() OVER (ORDER BY md5('42|' || cell_id), cell_id) AS r, count(*) OVER () AS n FROM cells) SELECT cell_id, CASE WHEN r <= round_even(n * 0.6, 0) THEN 'train' WHEN r <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'val' ELSE 'test' END AS part FROM r")
def split_random_debug(spark: S, d: str) -> DataFrame:
    return random_split(X.cells(spark, d))


_OLD_HASH = "md5(string_agg(CAST(donor_id AS VARCHAR), ',' ORDER BY donor_id))"


@query("chk_hashes", with_(CELLS, SPLIT, NODES, knn(20), edges()) + f"SELECT 'split' AS artifact, part AS name, {_OLD_HASH} AS content, true AS same FROM split GROUP BY 2 UNION ALL SELECT 'graph', 'written', {content_sql('src', 'dst')}, true FROM edges UNION ALL SELECT 'graph', 'tampered', {content_sql('src', 'dst')}, false FROM (SELECT src, CASE WHEN src % 7 = 0 THEN dst + 1 ELSE dst END AS dst FROM edges)")
def chk_hashes(spark: S, d: str) -> DataFrame:
    """Hashes of the split's parts; the hash of a stored graph's edges, found again and held against its manifest; the same for a
    copy in which some edges were changed after the manifest was written."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("donor_id")), lambda x: x.cast("string")), ",")
    parts = split(spark, d).groupBy(F.lit("split").alias("artifact"), F.col("part").alias("name")).agg(F.md5(ids).alias("content")).withColumn("same", F.lit(True))
    n = X.nodes(spark, d)
    home = artifacts.write_graph_bundle(written(G.pca_knn(n, 20), "edges"), n, "pca_knn_k20")
    e, said = artifacts.read_graph_bundle(spark, home)
    changed = e.withColumn("dst", F.when(F.col("src") % 7 == 0, F.col("dst") + 1).otherwise(F.col("dst")))
    out = parts
    for name, df in (("written", e), ("tampered", changed)):
        got = df.agg(G.edge_hash().alias("content")).crossJoin(said.select("edge_hash"))  # two rows of one
        out = out.unionByName(got.select(F.lit("graph").alias("artifact"), F.lit(name).alias("name"), "content", (F.col("content") == F.col("edge_hash")).alias("same")))
    return out


@query("snk_split", with_(CELLS, SPLIT) + "SELECT part, count(*) AS donors FROM split GROUP BY 1")
def snk_split(spark: S, d: str) -> DataFrame:
    return files.read_split(spark, files.write_split(split(spark, d))).groupBy("part").agg(F.count("*").alias("donors"))


_AUDIT = """
funnel AS (SELECT 'filtering_funnel' AS artifact, stage AS name, count(*) AS value FROM (SELECT 'raw' AS stage FROM cells UNION ALL SELECT 'site' FROM cells WHERE site <> 4 UNION ALL SELECT 'label' FROM cells WHERE site <> 4 AND cell_type <> 'HOUSEHOLD') GROUP BY 2),
ds AS (SELECT 'donor_counts_by_stage', CAST(donor_id AS VARCHAR), count(*) FILTER (site <> 4 AND cell_type <> 'HOUSEHOLD') FROM cells GROUP BY 2),
pairs AS (SELECT 'cell_type_by_donor', cell_type || '|' || donor_id, count(*) FROM cells WHERE site <> 4 AND cell_type <> 'HOUSEHOLD' GROUP BY 2),
sup AS (SELECT 'label_support_by_split', cell_type || '|' || part, count(*) FROM cells JOIN split USING (donor_id) WHERE cells.site <> 4 AND cell_type <> 'HOUSEHOLD' GROUP BY 2),
pol AS (SELECT 'label_policy', cell_type, count(DISTINCT donor_id) FROM cells WHERE site <> 4 AND cell_type <> 'HOUSEHOLD' GROUP BY 2),
man AS (SELECT 'source_manifest', 'cells', count(*) FROM cells UNION ALL SELECT 'source_manifest', 'genes', count(DISTINCT gene_id) FROM counts),
md AS (SELECT 'audit_summary', 'passed', 6)"""


@query("snk_audit", with_(CELLS, COUNTS, SPLIT, _AUDIT) + "SELECT * FROM funnel UNION ALL SELECT * FROM ds UNION ALL SELECT * FROM pairs UNION ALL SELECT * FROM sup UNION ALL SELECT * FROM pol UNION ALL SELECT * FROM man UNION ALL SELECT * FROM md")
def snk_audit(spark: S, d: str) -> DataFrame:
    """The seven artifacts of an audit written, and read back as (artifact, name, value)."""
    stages = [("raw", F.lit(True)), ("site", F.col("site") != 4), ("label", F.col("cell_type") != "HOUSEHOLD")]
    home = artifacts.write_audit(X.cells(spark, d), X.counts(spark, d), split(spark, d), stages)
    return artifacts.read_audit(spark, home)
