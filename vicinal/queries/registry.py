"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name; a name can be taken once."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"a query {name} is there already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CELLS = "cells AS (SELECT c_custkey AS cell_id, c_nationkey AS donor_id, n_regionkey AS site, c_mktsegment AS cell_type FROM customer JOIN nation ON c_nationkey = n_nationkey)"
COUNTS = "counts AS (SELECT o_custkey AS cell_id, concat_ws('/', p_brand, p_type) AS gene_id, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
MANIFEST = "manifest AS (SELECT n_nationkey AS donor_id, r_name AS site, CASE WHEN n_regionkey = 4 OR n_name LIKE 'I%' THEN 'excluded' ELSE 'included' END AS inclusion_status, CASE WHEN n_name LIKE 'I%' THEN 'perturbed' ELSE 'none' END AS perturbation_status FROM nation JOIN region ON n_regionkey = r_regionkey)"
SPLIT = """
sd AS (SELECT donor_id, min(site) AS site FROM cells GROUP BY 1),
sn AS (SELECT *, count(*) OVER (PARTITION BY site) AS n, row_number() OVER (PARTITION BY site ORDER BY md5('42|' || donor_id), donor_id) AS pos FROM sd),
ss AS (SELECT *, greatest(1, CAST(round_even(n * 0.6, 0) AS INT)) AS tr, greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) AS va FROM sn),
split AS (SELECT donor_id, site, CASE WHEN pos <= tr THEN 'train' WHEN pos <= tr + va THEN 'val' ELSE 'test' END AS part FROM ss)"""
NODES = """nodes AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS x, label AS y, vec_id % 23 AS donor,
  CASE WHEN vec_id % 23 < 12 THEN 'Cambridge' ELSE 'Newcastle' END AS site,
  CASE WHEN vec_id % 23 IN (0,1,2,3,4,5,12,13,14,15,16,17) THEN 'train' WHEN vec_id % 23 IN (6,7,8,18,19,20) THEN 'val' ELSE 'test' END AS part FROM embeddings)"""


def knn(k: int, group: str = "", name: str = "knn") -> str:
    by = f"d.node, s.{group}" if group else "d.node"
    return f"""{name} AS (SELECT * FROM (SELECT s.node AS src, d.node AS dst, d.part AS dpart, list_distance(s.x, d.x) AS dist,
  row_number() OVER (PARTITION BY {by} ORDER BY list_distance(s.x, d.x), s.node) AS r
  FROM nodes s JOIN nodes d ON s.part = 'train' AND s.node <> d.node) WHERE r <= {k})"""


def edges(of: str = "knn", name: str = "edges") -> str:
    return f"{name} AS (SELECT src, dst, min(dist) AS dist FROM (SELECT src, dst, dist FROM {of} UNION ALL SELECT dst, src, dist FROM {of} WHERE dpart = 'train') GROUP BY 1, 2)"


ENDS = "ends AS (SELECT e.src, e.dst, e.dist, a.y AS s_y, a.donor AS s_donor, a.site AS s_site, a.part AS s_part, b.y AS d_y, b.donor AS d_donor, b.site AS d_site, b.part AS d_part FROM edges e JOIN nodes a ON e.src = a.node JOIN nodes b ON e.dst = b.node)"
PURITY = "purity AS (SELECT dst, d_part AS part, d_y AS y, avg(CAST(s_y = d_y AS INT)) AS purity FROM ends GROUP BY 1, 2, 3)"
CENTROID = """
cv AS (SELECT y, i, avg(x[i]) AS v FROM nodes, range(1, 65) t(i) WHERE part = 'train' GROUP BY 1, 2),
cc AS (SELECT y AS c, list(v ORDER BY i) AS v FROM cv GROUP BY 1),
pred AS (SELECT node, y, donor, site, part, c AS yhat FROM (SELECT n.*, c, row_number() OVER (PARTITION BY node ORDER BY round(list_distance(x, v), 9), c) AS r FROM nodes n, cc) WHERE r = 1)"""
VOTE = """
vn AS (SELECT dst, y, count(*) AS n FROM edges JOIN nodes ON src = node GROUP BY 1, 2),
vote AS (SELECT n.node, n.y, n.donor, n.site, n.part, coalesce(v.y, -1) AS yhat FROM nodes n LEFT JOIN (SELECT dst, y, row_number() OVER (PARTITION BY dst ORDER BY n DESC, y) AS r FROM vn) v ON v.dst = n.node AND r = 1)"""
RUNS = """
ro AS (SELECT o_orderkey % 12 AS m, count(*) AS n, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS k FROM orders GROUP BY 1),
runs AS (SELECT 'run' || lpad(CAST(m AS VARCHAR), 2, '0') AS run_id, CASE WHEN m < 3 THEN 'mlp' WHEN m < 8 THEN 'gcn' ELSE 'graphsage' END AS model,
  CASE WHEN m < 3 THEN 'none' WHEN m % 2 = 0 THEN 'pca_knn_k20' ELSE 'bbknn' END AS graph, CAST([7, 17, 42, 73][m % 4 + 1] AS INT) AS seed,
  CASE WHEN m = 5 THEN 'other' ELSE 'f1' END AS feature_hash, round(CAST(k AS DOUBLE) / n, 6) AS macro_f1, round(CAST(k AS DOUBLE) / (n + m), 6) AS balanced_accuracy FROM ro)"""
LIFTS = """
lifts AS (SELECT r.run_id, r.model, r.graph, r.seed, CASE WHEN b.run_id IS NULL THEN 'unmatched' WHEN b.feature_hash <> r.feature_hash THEN 'mismatched' ELSE 'matched' END AS match_status,
  CASE WHEN b.feature_hash <> r.feature_hash THEN 'feature_hash' ELSE '' END AS differ, b.run_id AS baseline_run_id,
  CASE WHEN b.feature_hash = r.feature_hash THEN r.macro_f1 - b.macro_f1 END AS l1, CASE WHEN b.feature_hash = r.feature_hash THEN r.balanced_accuracy - b.balanced_accuracy END AS l2
  FROM runs r LEFT JOIN runs b ON b.model = 'mlp' AND b.seed = r.seed WHERE r.model <> 'mlp')"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def content_sql(*values: str) -> str:
    """The SQL of vicinal.functions.scalars.content_hash."""
    h = f"sha256(concat_ws(',', {', '.join(f'CAST({v} AS VARCHAR)' for v in values)}))"
    sums = ", ".join(f"CAST(sum(CAST('0x' || substr({h}, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))
    return f"sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {sums}))"
