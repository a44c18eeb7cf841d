"""Neighbour graphs and their diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.scalars import r6
from vicinal.operators import diagnostics as D
from vicinal.operators import graph as G
from vicinal.operators import models as M
from vicinal.plans import fixtures as X
from vicinal.queries.registry import CENTROID, ENDS, NODES, PURITY, content_sql, edges, knn, query, with_
from vicinal.session import fresh, written
from vicinal.sources import files

S = SparkSession
K20 = (NODES, knn(20), edges())
ALL = (*K20, ENDS)


def graph(spark: S, d: str) -> DataFrame:
    return G.pca_knn(X.nodes(spark, d), 20)


def ends(spark: S, d: str) -> DataFrame:
    return D.attributed(graph(spark, d), X.nodes(spark, d))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _rank(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", F.col("rank").cast("bigint").alias("rank"), r6("dist").alias("dist"))


_RANKED = "SELECT src, dst, r AS rank, round(dist, 6) AS dist FROM knn WHERE "


@query("knn_train", with_(NODES, knn(20)) + _RANKED + "dpart = 'train'")
def knn_train(spark: S, d: str) -> DataFrame:
    return _rank(X.train_knn(spark, d))


@query("knn_query_val", with_(NODES, knn(20)) + _RANKED + "dpart = 'val'")
def knn_query_val(spark: S, d: str) -> DataFrame:
    return _rank(X.query_knn(spark, d, 20, "val"))


@query("knn_query_test", with_(NODES, knn(20)) + _RANKED + "dpart = 'test'")
def knn_query_test(spark: S, d: str) -> DataFrame:
    return _rank(X.query_knn(spark, d, 20, "test"))


@query("join_knn", with_(NODES, knn(5)) + _RANKED + "dpart <> 'train'")
def join_knn(spark: S, d: str) -> DataFrame:
    return _rank(X.query_knn(spark, d, 5))


@query("win_knn_rank", with_(NODES, knn(5)) + "SELECT dst, list(src ORDER BY r) AS nearest FROM knn GROUP BY 1")
def win_knn_rank(spark: S, d: str) -> DataFrame:
    n = X.nodes(spark, d)
    return G.nearest(n, n.filter("part = 'train'"), 5).groupBy("dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "src"))), lambda s: s["src"]).alias("nearest"))


@query("join_knn_grouped", with_(NODES, knn(2, "donor")) + "SELECT src, dst, r AS rank FROM knn WHERE dpart = 'test'")
def join_knn_grouped(spark: S, d: str) -> DataFrame:
    n = X.nodes(spark, d)
    return G.nearest(n.filter("part = 'test'"), n.filter("part = 'train'"), 2, "donor").select("src", "dst", F.col("rank").cast("bigint").alias("rank"))


@query("knn_symmetrize", with_(NODES, knn(20), edges()) + "SELECT src, dst, round(dist, 6) AS dist FROM edges JOIN nodes ON dst = node WHERE part = 'train'")
def knn_symmetrize(spark: S, d: str) -> DataFrame:
    return rounded(G.symmetrised(X.train_knn(spark, d)))


@query("set_union_distinct", with_(NODES, knn(20), edges()) + "SELECT count(*) AS n FROM edges")
def set_union_distinct(spark: S, d: str) -> DataFrame:
    return graph(spark, d).agg(F.count("*").alias("n"))


@query("knn_sigma", with_(NODES, knn(20)) + "SELECT round(median(dist), 6) AS sigma FROM knn WHERE r = 20 AND dpart = 'train'")
def knn_sigma(spark: S, d: str) -> DataFrame:
    return rounded(G.sigma(X.train_knn(spark, d), 20))


_SIGMA = "sg AS (SELECT median(dist) AS s FROM knn WHERE r = 20 AND dpart = 'train'), rbf AS (SELECT src, dst, exp(-dist * dist / (2 * s * s)) AS weight FROM edges, sg)"


@query("knn_rbf", with_(*K20, _SIGMA) + "SELECT src, dst, round(weight, 6) AS weight FROM rbf")
def knn_rbf(spark: S, d: str) -> DataFrame:
    return rounded(G.pca_knn(X.nodes(spark, d), 20, weighted=True).select("src", "dst", "weight"))


@query("diag_weights", with_(*K20, _SIGMA) + "SELECT round(min(weight), 6) AS least, round(max(weight), 6) AS most, round(avg(weight), 6) AS mean, round(median(weight), 6) AS median, round(stddev_pop(weight), 6) AS sd FROM rbf")
def diag_weights(spark: S, d: str) -> DataFrame:
    return rounded(D.weight_summary(G.pca_knn(X.nodes(spark, d), 20, weighted=True)))


@query("graph_pca_knn", with_(*ALL) + "SELECT 'train->' || d_part AS kind, count(*) AS edges, round(avg(CAST(s_y = d_y AS INT)), 6) AS homophily FROM ends GROUP BY 1")
def graph_pca_knn(spark: S, d: str) -> DataFrame:
    """Flagship: the graph, its ends' labels, and homophily by kind of edge."""
    return ends(spark, d).groupBy(F.concat(F.lit("train->"), F.col("d_part")).alias("kind")).agg(F.count("*").alias("edges"), r6(F.avg((F.col("s_y") == F.col("d_y")).cast("int"))).alias("homophily"))


@query("sort_edges", with_(*K20) + "SELECT src, dst FROM edges")
def sort_edges(spark: S, d: str) -> DataFrame:
    return graph(spark, d).select("src", "dst").orderBy("src", "dst")


_MUTUAL = "mut AS (SELECT a.src, a.dst, (a.dist + b.dist) / 2 AS dist FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src AND a.dpart = 'train' AND b.dpart = 'train')"


@query("join_mutual", with_(NODES.replace("AS (", "AS MATERIALIZED (", 1), knn(20).replace("AS (", "AS MATERIALIZED (", 1), _MUTUAL) + "SELECT src, dst, round(dist, 6) AS dist FROM mut")
def join_mutual(spark: S, d: str) -> DataFrame:
    return rounded(G.mutual(X.train_knn(spark, d)))


@query("graph_mutual_knn", with_(NODES, knn(20), _MUTUAL) + "SELECT src, dst, round(dist, 6) AS dist FROM mut UNION ALL SELECT src, dst, round(dist, 6) FROM knn WHERE dpart <> 'train'")
def graph_mutual_knn(spark: S, d: str) -> DataFrame:
    return rounded(G.mutual_knn(X.nodes(spark, d), 20))


@query("graph_bbknn", with_(NODES, knn(2, "donor"), edges()) + "SELECT src, dst, round(dist, 6) AS dist FROM edges")
def graph_bbknn(spark: S, d: str) -> DataFrame:
    return rounded(G.bbknn(X.nodes(spark, d), 2))


@query("graph_rewired")
def graph_rewired(spark: S, d: str) -> DataFrame:
    n = X.nodes(spark, d)
    return G.rewired(written(graph(spark, d), "edges"), n)


@query("graph_count_kinds", with_(*ALL) + "SELECT CASE WHEN s_part = 'train' THEN 'train->' || d_part ELSE 'disallowed' END AS kind, count(*) AS n FROM ends GROUP BY 1")
def graph_count_kinds(spark: S, d: str) -> DataFrame:
    return G.kinds(graph(spark, d), X.nodes(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("chk_edge_direction", with_(*ALL) + "SELECT count(*) FILTER (s_part <> 'train') AS bad, count(*) FILTER (src = dst) AS loops FROM ends")
def chk_edge_direction(spark: S, d: str) -> DataFrame:
    k = G.kinds(graph(spark, d), X.nodes(spark, d))
    return k.agg(F.count_if(F.col("kind") == "disallowed").alias("bad"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


_MANIFEST = "'{name}' AS graph_name, 'pca_knn' AS builder_type, 20 AS k, 20 AS nominal_train_k, 20 AS nominal_query_k, 'standard_knn' AS reference_edge_policy, 'standard_knn' AS query_edge_policy, 'euclidean' AS metric, '{weighting}' AS weighting, 'source_to_target' AS edge_index_convention, 'train_to_train' AS message_flow_train, 'train_to_validation' AS message_flow_validation, 'train_to_test' AS message_flow_test, false AS query_nodes_affect_training"
_COUNTED = "mn AS (SELECT count(*) AS num_nodes, count(*) FILTER (part = 'train') AS num_train_nodes, count(*) FILTER (part = 'val') AS num_val_nodes, count(*) FILTER (part = 'test') AS num_test_nodes, " + content_sql("node", "part") + " AS node_hash FROM nodes), me AS (SELECT count(*) AS num_edges, count(*) FILTER (s_part = 'train' AND d_part = 'train') AS num_train_train_edges, count(*) FILTER (s_part = 'train' AND d_part = 'val') AS num_train_to_val_edges, count(*) FILTER (s_part = 'train' AND d_part = 'test') AS num_train_to_test_edges, count(*) FILTER (s_part <> 'train') AS num_disallowed_edges, " + content_sql("src", "dst") + " AS edge_hash FROM ends)"


@query("graph_manifest", with_(*ALL, _COUNTED, _SIGMA) + "SELECT mn.*, me.*, NULL::VARCHAR AS weight_hash, NULL::DOUBLE AS sigma_k, " + _MANIFEST.format(name="pca_knn_k20", weighting="unweighted") + " FROM mn, me UNION ALL BY NAME SELECT mn.*, me.*, NULL::VARCHAR AS weight_hash, round(s, 6) AS sigma_k, " + _MANIFEST.format(name="pca_knn_k20_rbf", weighting="rbf") + " FROM mn, me, sg")
def graph_manifest(spark: S, d: str) -> DataFrame:
    """Manifests of the plain and the weighted graph; the weights' hash is left to the tests, as engines round differently."""
    n = written(X.nodes(spark, d), "nodes")
    train = written(G.knn_train(n, 20), "knn")
    edges = written(G.symmetrised(train).unionByName(G.knn_query(n, 20).select("src", "dst", "dist")), "edges")
    width = written(G.sigma(train, 20), "sigma")
    both = G.manifest(edges, n, "pca_knn_k20").unionByName(G.manifest(G.rbf(edges, width), n, "pca_knn_k20_rbf", width=width))
    return both.withColumns({"weight_hash": F.lit(None).cast("string"), "sigma_k": r6("sigma_k")})


@query("src_graph", with_(*ALL) + "SELECT 'train->' || d_part AS kind, count(*) AS n, count(DISTINCT dst) AS targets FROM ends GROUP BY 1")
def src_graph(spark: S, d: str) -> DataFrame:
    path = files.write_graph(G.kinds(graph(spark, d), X.nodes(spark, d)))
    return files.read_graph(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("targets"))


@query("graph_to_data", with_(NODES) + "SELECT node, part, CASE WHEN part = 'train' THEN y ELSE -1 END AS y, round(list_sum(x), 4) AS total FROM nodes")
def graph_to_data(spark: S, d: str) -> DataFrame:
    return G.to_data(X.nodes(spark, d)).select("node", "part", "y", F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("prj_mask_labels", with_(NODES) + "SELECT node, CASE WHEN part = 'train' THEN y ELSE -1 END AS y FROM nodes")
def prj_mask_labels(spark: S, d: str) -> DataFrame:
    return G.to_data(X.nodes(spark, d)).select("node", "y")


@query("prj_concat_parts", with_(NODES) + "SELECT part, count(*) AS n, len(any_value(x)) AS width FROM nodes GROUP BY 1")
def prj_concat_parts(spark: S, d: str) -> DataFrame:
    n = X.nodes(spark, d)
    out = n.filter("part = 'train'").unionByName(n.filter("part = 'val'")).unionByName(n.filter("part = 'test'"))
    return out.groupBy("part").agg(F.count("*").alias("n"), F.max(F.size("x")).cast("bigint").alias("width"))


@query("graph_variants", with_(NODES, knn(20), _MUTUAL, *(x for n, k, g in (("k10", 10, ""), ("k20", 20, ""), ("k24", 24, ""), ("k50", 50, ""), ("bb2", 2, "donor")) for x in (knn(k, g, f"k_{n}"), edges(f"k_{n}", f"e_{n}"))), "e_mutual20 AS (SELECT * FROM mut UNION ALL SELECT src, dst, dist FROM knn WHERE dpart <> 'train')") + " UNION ALL ".join(f"SELECT '{n}' AS graph, count(*) AS edges, round(avg(dist), 6) AS dist, 1.0::DOUBLE AS weight FROM e_{n}" for n in ("k10", "k20", "k24", "k50", "mutual20", "bb2")) + " UNION ALL SELECT 'k20_rbf', count(*), round(avg(dist), 6), round(avg(exp(-dist * dist / (2 * s * s))), 6) FROM e_k20, (SELECT median(dist) AS s FROM knn WHERE r = 20 AND dpart = 'train')")
def graph_variants(spark: S, d: str) -> DataFrame:
    """Edges, mean distance and mean weight of each graph of the sweep; the rewired one is `graph_rewired`. The k-NN of the largest k is found once; smaller ones are its first ranks."""
    n = written(X.nodes(spark, d), "nodes")
    train, ask = written(G.knn_train(n, 50), "knn"), written(G.knn_query(n, 50), "knn")

    def plain(k: int) -> DataFrame:
        return G.symmetrised(train.filter(F.col("rank") <= k)).unionByName(ask.filter(F.col("rank") <= k).select("src", "dst", "dist"))

    mutual = G.mutual(train.filter("rank <= 20")).unionByName(ask.filter("rank <= 20").select("src", "dst", "dist"))
    graphs = {f"k{k}": plain(k) for k in (10, 20, 24, 50)} | {"mutual20": mutual, "bb2": G.bbknn(n, 2)}
    graphs["k20_rbf"] = G.rbf(graphs["k20"], G.sigma(train, 20))
    out = None
    for name, e in graphs.items():
        weight = F.avg("weight") if "weight" in e.columns else F.lit(1.0)
        one = e.agg(F.lit(name).alias("graph"), F.count("*").alias("edges"), r6(F.avg("dist")).alias("dist"), r6(weight).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


@query("join_edge_attrs", with_(*ALL) + "SELECT src, dst, s_y, d_y, s_donor, d_donor, s_site, d_site FROM ends")
def join_edge_attrs(spark: S, d: str) -> DataFrame:
    return ends(spark, d).select("src", "dst", "s_y", "d_y", "s_donor", "d_donor", "s_site", "d_site")


@query("join_node_meta", with_(NODES) + "SELECT node, donor, site FROM nodes")
def join_node_meta(spark: S, d: str) -> DataFrame:
    return X.nodes(spark, d).select("node", "donor", "site")


_DEG = "deg AS (SELECT node, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM nodes LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON i.dst = node LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON o.src = node)"


def degrees(spark: S, d: str) -> DataFrame:
    return D.degrees(graph(spark, d), X.nodes(spark, d))


@query("diag_degree", with_(*K20, _DEG) + ", s AS (SELECT 'in' AS side, n_in AS n FROM deg UNION ALL SELECT 'out', n_out FROM deg) SELECT side, round(avg(n), 6) AS mean, median(n) AS median, round(stddev_pop(n), 6) AS sd, min(n) AS least, max(n) AS most FROM s GROUP BY 1")
def diag_degree(spark: S, d: str) -> DataFrame:
    return rounded(D.degree_summary(degrees(spark, d)))


@query("diag_isolated", with_(*K20, _DEG) + "SELECT count(*) FILTER (n_in + n_out = 0) AS isolated, round(count(*) FILTER (n_in + n_out = 0) / count(*), 6) AS fraction FROM deg")
def diag_isolated(spark: S, d: str) -> DataFrame:
    return rounded(D.isolated(degrees(spark, d)))


@query("diag_density", with_(*K20) + "SELECT (SELECT count(*) FROM edges) AS e, count(*) AS n, round((SELECT count(*) FROM edges) / (count(*) * (count(*) - 1)), 6) AS density FROM nodes")
def diag_density(spark: S, d: str) -> DataFrame:
    return rounded(D.density(graph(spark, d), X.nodes(spark, d)))




@query("diag_components", "WITH RECURSIVE " + ",\n".join([NODES, knn(20).replace("AS (", "AS MATERIALIZED (", 1), "e AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM knn)", "e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e)", "walk AS (SELECT node, node AS comp FROM nodes UNION SELECT b, comp FROM walk JOIN e2 ON a = node WHERE comp < b)"]) + "\n, lab AS (SELECT node, min(comp) AS comp FROM walk GROUP BY 1), sz AS (SELECT comp, count(*) AS n FROM lab GROUP BY 1) SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 6) AS fraction FROM sz")
def diag_components(spark: S, d: str) -> DataFrame:
    return rounded(D.component_summary(D.components(graph(spark, d), X.nodes(spark, d))))


@query("diag_edge_homophily", with_(*ALL) + "SELECT round(avg(CAST(s_y = d_y AS INT)), 6) AS overall, round(avg(CAST(s_y = d_y AS INT)) FILTER (s_part = 'train' AND d_part = 'train'), 6) AS train FROM ends")
def diag_edge_homophily(spark: S, d: str) -> DataFrame:
    return rounded(D.edge_homophily(ends(spark, d)))


_BY_PART = "SELECT round(avg(purity), 6) AS overall, round(avg(purity) FILTER (part = 'train'), 6) AS train, round(avg(purity) FILTER (part = 'val'), 6) AS val, round(avg(purity) FILTER (part = 'test'), 6) AS test FROM purity"


@query("diag_node_homophily", with_(*ALL, PURITY) + _BY_PART)
def diag_node_homophily(spark: S, d: str) -> DataFrame:
    return rounded(D.node_homophily(D.node_purity(ends(spark, d))))


@query("diag_query_homophily", with_(*ALL, PURITY) + "SELECT part, round(avg(purity), 6) AS purity, count(*) AS nodes FROM purity WHERE part <> 'train' GROUP BY 1")
def diag_query_homophily(spark: S, d: str) -> DataFrame:
    return D.node_purity(ends(spark, d)).filter("part <> 'train'").groupBy("part").agg(r6(F.avg("purity")).alias("purity"), F.count("*").alias("nodes"))


_EXPECTED = """sh AS (SELECT y, count(*) / (SELECT count(*) FROM nodes) AS a, count(*) FILTER (part = 'train') / (SELECT count(*) FROM nodes WHERE part = 'train') AS tr,
 count(*) FILTER (part = 'val') / (SELECT count(*) FROM nodes WHERE part = 'val') AS va, count(*) FILTER (part = 'test') / (SELECT count(*) FROM nodes WHERE part = 'test') AS te FROM nodes GROUP BY 1),
ex AS (SELECT sum(a * a) AS overall, sum(tr * tr) AS train, sum(tr * va) AS val, sum(tr * te) AS test FROM sh)"""


@query("diag_expected", with_(NODES, _EXPECTED) + "SELECT round(overall, 6) AS overall, round(train, 6) AS train, round(val, 6) AS val, round(test, 6) AS test FROM ex")
def diag_expected(spark: S, d: str) -> DataFrame:
    return rounded(D.expected(X.nodes(spark, d)))


@query("diag_lifts", with_(*ALL, PURITY, _EXPECTED) + ", o AS (SELECT avg(purity) AS overall, avg(purity) FILTER (part = 'train') AS train, avg(purity) FILTER (part = 'val') AS val, avg(purity) FILTER (part = 'test') AS test FROM purity) SELECT round(o.overall - ex.overall, 6) AS overall, round(o.train - ex.train, 6) AS train, round(o.val - ex.val, 6) AS val, round(o.test - ex.test, 6) AS test FROM o, ex")
def diag_lifts(spark: S, d: str) -> DataFrame:
    o, e = D.node_homophily(D.node_purity(ends(spark, d))), D.expected(X.nodes(spark, d))
    names = ["overall", "train", "val", "test"]
    both = o.crossJoin(e.select(*(F.col(c).alias(f"e_{c}") for c in names)))
    return both.select(*(r6(F.col(c) - F.col(f"e_{c}")).alias(c) for c in names))


@query("diag_class_purity", with_(*ALL, PURITY) + "SELECT y, round(coalesce(avg(purity), 0), 6) AS purity FROM (SELECT DISTINCT y FROM nodes) LEFT JOIN purity USING (y) GROUP BY 1")
def diag_class_purity(spark: S, d: str) -> DataFrame:
    return rounded(D.class_purity(D.node_purity(ends(spark, d)), X.nodes(spark, d)))


def _mix(name: str, cond: str, same: str, out: str) -> None:
    @query(name, with_(*ALL) + f"SELECT round(avg(CAST({same} AS INT)) FILTER ({cond}), 6) AS {out} FROM ends")
    def run(spark: S, d: str) -> DataFrame:
        return rounded(D.mixing(ends(spark, d)).select(out))


_mix("diag_intra_donor", "d_part = 'train'", "s_donor = d_donor", "intra_donor")
_mix("diag_intra_site", "d_part = 'train'", "s_site = d_site", "intra_site")


@query("diag_site_match", with_(*ALL) + "SELECT round(avg(CAST(s_site = d_site AS INT)) FILTER (d_part = 'val'), 6) AS val_site_match, round(avg(CAST(s_site = d_site AS INT)) FILTER (d_part = 'test'), 6) AS test_site_match FROM ends")
def diag_site_match(spark: S, d: str) -> DataFrame:
    return rounded(D.mixing(ends(spark, d)).select("val_site_match", "test_site_match"))


@query("diag_entropy", with_(*ALL) + """, en AS (SELECT dst, s_donor AS g, count(*) AS n FROM ends GROUP BY 1, 2), eb AS (SELECT dst, -sum(n / t * log2(n / t + 1e-12)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY dst) AS t FROM en) GROUP BY 1)
SELECT part, round(avg(coalesce(bits, 0)), 6) AS bits FROM nodes LEFT JOIN eb ON dst = node GROUP BY 1""")
def diag_entropy(spark: S, d: str) -> DataFrame:
    return rounded(D.entropy_summary(D.entropy(ends(spark, d), X.nodes(spark, d), "donor")))


_COMPONENTS = """e1 AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges), e2 AS MATERIALIZED (SELECT a, b FROM e1 UNION SELECT b, a FROM e1),
walk AS (SELECT node, node AS comp FROM nodes UNION SELECT b, comp FROM walk JOIN e2 ON a = node WHERE comp < b),
sz AS (SELECT comp, count(*) AS n FROM (SELECT node, min(comp) AS comp FROM walk GROUP BY 1) GROUP BY 1)"""
_FLAT = with_(*ALL, PURITY, _EXPECTED, _DEG, _COMPONENTS).replace("WITH", "WITH RECURSIVE", 1) + """, mx AS (SELECT avg(CAST(s_donor = d_donor AS INT)) FILTER (d_part = 'train') AS a, avg(CAST(s_site = d_site AS INT)) FILTER (d_part = 'train') AS b,
  avg(CAST(s_site = d_site AS INT)) FILTER (d_part = 'val') AS c, avg(CAST(s_site = d_site AS INT)) FILTER (d_part = 'test') AS d FROM ends),
m AS (
SELECT 'edge_homophily.overall' AS metric_name, avg(CAST(s_y = d_y AS INT)) AS value FROM ends
UNION ALL SELECT 'edge_homophily.train', avg(CAST(s_y = d_y AS INT)) FROM ends WHERE s_part = 'train' AND d_part = 'train'
UNION ALL SELECT 'node_homophily.' || coalesce(part, 'overall'), avg(purity) FROM purity GROUP BY GROUPING SETS ((part), ())
UNION ALL SELECT 'expected.overall', overall FROM ex UNION ALL SELECT 'expected.train', train FROM ex UNION ALL SELECT 'expected.val', val FROM ex UNION ALL SELECT 'expected.test', test FROM ex
UNION ALL SELECT 'isolated.isolated', count(*) FILTER (n_in + n_out = 0) FROM deg UNION ALL SELECT 'isolated.fraction', count(*) FILTER (n_in + n_out = 0) / count(*) FROM deg
UNION ALL SELECT 'density.e', count(*) FROM edges UNION ALL SELECT 'density.n', count(*) FROM nodes
UNION ALL SELECT 'density.density', (SELECT count(*) FROM edges) / (count(*) * (count(*) - 1)) FROM nodes
UNION ALL SELECT 'components.components', count(*) FROM sz UNION ALL SELECT 'components.largest', max(n) FROM sz UNION ALL SELECT 'components.fraction', max(n) / sum(n) FROM sz
UNION ALL SELECT 'mixing.intra_donor', a FROM mx UNION ALL SELECT 'mixing.intra_site', b FROM mx UNION ALL SELECT 'mixing.val_site_match', c FROM mx UNION ALL SELECT 'mixing.test_site_match', d FROM mx)
SELECT metric_name, round(value, 6) AS value FROM m"""


@query("diag_report", _FLAT)
def diag_report(spark: S, d: str) -> DataFrame:
    """Every metric of the study graph, components among them."""
    return rounded(D.report(written(graph(spark, d), "edges"), X.nodes(spark, d)))


@query("diag_flatten", with_(*K20, _DEG) + "SELECT 'isolated.isolated' AS metric_name, CAST(count(*) FILTER (n_in + n_out = 0) AS DOUBLE) AS value FROM deg UNION ALL SELECT 'isolated.fraction', round(count(*) FILTER (n_in + n_out = 0) / count(*), 6) FROM deg")
def diag_flatten(spark: S, d: str) -> DataFrame:
    return rounded(D.flattened(D.isolated(degrees(spark, d)), "isolated"))


@query("snk_diag", with_(*K20, _DEG) + "SELECT 'isolated.isolated' AS metric_name, CAST(count(*) FILTER (n_in + n_out = 0) AS DOUBLE) AS value FROM deg UNION ALL SELECT 'isolated.fraction', round(count(*) FILTER (n_in + n_out = 0) / count(*), 6) FROM deg")
def snk_diag(spark: S, d: str) -> DataFrame:
    path = files.write_table(diag_flatten(spark, d), "csv")
    return spark.read.schema("metric_name string, value double").option("header", True).csv(path)


@query("msg_sage_mean", with_(*K20) + ", i AS (SELECT unnest(range(1, 65)) AS i) SELECT node, round(sum(abs(coalesce(v, 0))), 4) AS total FROM nodes CROSS JOIN i LEFT JOIN (SELECT dst, i, avg(x[i]) AS v FROM edges JOIN nodes ON src = node, i GROUP BY 1, 2) m ON m.dst = node AND m.i = i.i GROUP BY 1")
def msg_sage_mean(spark: S, d: str) -> DataFrame:
    return D.mean_features(graph(spark, d), X.nodes(spark, d)).select("node", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)), 4).alias("total"))


@query("msg_gcn", with_(*K20) + ", l AS (SELECT src, dst FROM edges UNION ALL SELECT node, node FROM nodes), dg AS (SELECT dst AS node, count(*) AS n FROM l GROUP BY 1), i AS (SELECT unnest(range(1, 65)) AS i) SELECT dst AS node, round(sum(abs(v)), 4) AS total FROM (SELECT l.dst, i, sum(x[i] / sqrt(a.n::DOUBLE * b.n)) AS v FROM l JOIN nodes ON l.src = node JOIN dg a ON a.node = l.src JOIN dg b ON b.node = l.dst, i GROUP BY 1, 2) GROUP BY 1")
def msg_gcn(spark: S, d: str) -> DataFrame:
    return D.normalised_features(graph(spark, d), X.nodes(spark, d)).select("node", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)), 4).alias("total"))


@query("snk_graph", with_(*ALL) + "SELECT src, dst, round(dist, 6) AS dist FROM ends WHERE d_part = 'val'")
def snk_graph(spark: S, d: str) -> DataFrame:
    """Edges written by kind; only one kind's folder is read."""
    path = files.write_graph(G.kinds(graph(spark, d), X.nodes(spark, d)))
    return rounded(files.read_graph(spark, path).filter("kind = 'train->val'").select("src", "dst", "dist"))


@query("snk_bundle", with_(NODES) + "SELECT node, y FROM nodes WHERE part = 'test'")
def snk_bundle(spark: S, d: str) -> DataFrame:
    """Features written by part; only one part's folder is read."""
    path = files.write_bundle(X.nodes(spark, d))
    return files.read_bundle(spark, path, "node bigint, x array<double>, y int, donor bigint, site string, part string", "test").select("node", "y")


@query("snk_model", with_(NODES, CENTROID) + "SELECT node, yhat, true AS same FROM pred")
def snk_model(spark: S, d: str) -> DataFrame:
    """A fitted model and its predictions written; the model read back predicts again, and `same` compares both."""
    n = X.nodes(spark, d)
    model, path = M.classifier("centroid").fit(n), fresh(spark, "model")
    model.save(spark, path)
    first = model.predict(n)
    stored = spark.read.schema(first.schema).parquet(files.write_table(first, "parquet", f"{path}/predictions"))
    again = M.load(spark, path).predict(n).withColumnRenamed("yhat", "again")
    return stored.join(again, "node").select("node", "yhat", (F.col("yhat") == F.col("again")).alias("same"))
