"""Models, evaluation, tracking of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.functions.scalars import r6
from vicinal.operators import evaluation as E
from vicinal.operators import models as M
from vicinal.operators import tracking as T
from vicinal.operators.graph import bbknn, edge_hash, pca_knn
from vicinal.operators.splitting import donor_split
from vicinal.operators.training import Prepared
from vicinal.plans import fixtures as X
from vicinal.queries.graphs import rounded
from vicinal.queries.registry import CELLS, CENTROID, LIFTS, NODES, RUNS, SPLIT, VOTE, content_sql, edges, knn, query, with_
from vicinal.session import fresh, written
from vicinal.sources import artifacts, files

S = SparkSession
PRED = (NODES, CENTROID)
CLASSWISE = """classes AS (SELECT DISTINCT y AS c FROM nodes),
cw AS (SELECT g, c AS y, count(*) FILTER (y = c) AS support, count(*) FILTER (yhat = c) AS predicted, count(*) FILTER (y = c AND yhat = c) AS hits FROM grp, classes GROUP BY 1, 2),
pc AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS "precision", CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f1 FROM cw)"""
MEAN = """CAST(sum(support) AS BIGINT) AS support, round(avg(f1), 6) AS macro_f1, round(avg("precision"), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
 round(sum(hits) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(f1) FILTER (support > 0), 6) AS observed_f1, count(*) FILTER (support > 0) AS present"""


def grp(by: str) -> str:
    return f"grp AS (SELECT {by} AS g, y, yhat FROM pred WHERE part = 'test')"


def pred(spark: S, d: str) -> DataFrame:
    return X.predictions(spark, d)


def test(spark: S, d: str) -> DataFrame:
    return pred(spark, d).filter("part = 'test'")


def classes(spark: S, d: str) -> DataFrame:
    return X.nodes(spark, d).select("y").distinct()


@query("model_predict", with_(NODES, knn(20), edges(), VOTE) + "SELECT node, yhat FROM vote")
def model_predict(spark: S, d: str) -> DataFrame:
    return X.predictions(spark, d, "vote").select("node", "yhat")


@query("eval_confusion", with_(*PRED) + ", c AS (SELECT DISTINCT y FROM nodes) SELECT a.y, b.y AS yhat, count(p.node) AS n FROM c a CROSS JOIN c b LEFT JOIN (SELECT * FROM pred WHERE part = 'test') p ON p.y = a.y AND p.yhat = b.y GROUP BY 1, 2")
def eval_confusion(spark: S, d: str) -> DataFrame:
    return E.confusion(test(spark, d), classes(spark, d))


@query("eval_per_class", with_(*PRED, grp("1"), CLASSWISE) + 'SELECT y, support, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc')
def eval_per_class(spark: S, d: str) -> DataFrame:
    return rounded(E.per_class(test(spark, d), classes(spark, d)).select("y", "support", "precision", "recall", "f1"))


@query("eval_global", with_(*PRED, grp("1"), CLASSWISE) + f"SELECT {MEAN} FROM pc")
def eval_global(spark: S, d: str) -> DataFrame:
    return rounded(E.summary(E.per_class(test(spark, d), classes(spark, d))))


@query("eval_balanced_acc", with_(*PRED, grp("part"), CLASSWISE) + "SELECT round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy FROM pc")
def eval_balanced_acc(spark: S, d: str) -> DataFrame:
    return rounded(E.summary(E.per_class(test(spark, d), classes(spark, d))).select("balanced_accuracy"))


@query("eval_per_donor", with_(*PRED, grp("donor"), CLASSWISE) + f"SELECT g AS donor, {MEAN} FROM pc GROUP BY 1")
def eval_per_donor(spark: S, d: str) -> DataFrame:
    return rounded(E.summary(E.per_class(test(spark, d), classes(spark, d), ["donor"]), ["donor"]))


@query("eval_per_site", with_(*PRED, grp("site"), CLASSWISE) + f"SELECT g AS site, {MEAN} FROM pc GROUP BY 1")
def eval_per_site(spark: S, d: str) -> DataFrame:
    return rounded(E.summary(E.per_class(test(spark, d), classes(spark, d), ["site"]), ["site"]))


_PIVOT = ", ".join(f"count(*) FILTER (yhat = {c}) AS Pred_{c}" for c in range(10))


@query("eval_cm_frame", with_(*PRED) + f"SELECT 'True_' || c.y AS label, {_PIVOT} FROM (SELECT DISTINCT y FROM nodes) c LEFT JOIN (SELECT * FROM pred WHERE part = 'test') p ON p.y = c.y GROUP BY c.y")
def eval_cm_frame(spark: S, d: str) -> DataFrame:
    return E.confusion_frame(eval_confusion(spark, d), list(range(10)))


@query("snk_cm", with_(*PRED) + f"SELECT 'True_' || c.y AS label, {_PIVOT} FROM (SELECT DISTINCT y FROM nodes) c LEFT JOIN (SELECT * FROM pred WHERE part = 'test') p ON p.y = c.y GROUP BY c.y")
def snk_cm(spark: S, d: str) -> DataFrame:
    df = eval_cm_frame(spark, d)
    return spark.read.schema(df.schema).option("header", True).csv(files.write_table(df, "csv"))


@query("topn_confusions", with_(*PRED) + ", c AS (SELECT y, yhat, count(*) AS n FROM pred WHERE part = 'test' GROUP BY 1, 2), s AS (SELECT y, sum(n) AS support FROM c GROUP BY 1) SELECT y, yhat, n, CAST(support AS BIGINT) AS support, round(n / support, 6) AS rate FROM c JOIN s USING (y) WHERE y <> yhat ORDER BY n DESC, y, yhat LIMIT 8")
def topn_confusions(spark: S, d: str) -> DataFrame:
    return rounded(E.top_confusions(eval_confusion(spark, d), 8)).select("y", "yhat", "n", "support", "rate")


_LIFTED = "SELECT run_id, model, graph, seed, match_status, differ, baseline_run_id, round(l1, 6) AS lift_macro_f1, round(l2, 6) AS lift_balanced_accuracy FROM lifts"


def lifts(spark: S, d: str) -> DataFrame:
    return T.matched(X.runs(spark, d), "mlp")


@query("join_matched_runs", with_(RUNS, LIFTS) + _LIFTED + " WHERE match_status = 'matched'")
def join_matched_runs(spark: S, d: str) -> DataFrame:
    return rounded(lifts(spark, d).filter("match_status = 'matched'"))


@query("trk_offline", with_(RUNS, LIFTS) + _LIFTED)
def trk_offline(spark: S, d: str) -> DataFrame:
    return rounded(lifts(spark, d))


@query("trk_match_all", with_(RUNS, LIFTS) + "SELECT match_status, count(*) AS n FROM lifts GROUP BY 1")
def trk_match_all(spark: S, d: str) -> DataFrame:
    return lifts(spark, d).groupBy("match_status").agg(F.count("*").alias("n"))


@query("trk_cli", with_(RUNS, LIFTS) + _LIFTED + " WHERE model = 'gcn' AND graph = 'bbknn'")
def trk_cli(spark: S, d: str) -> DataFrame:
    return rounded(lifts(spark, d).filter("model = 'gcn' and graph = 'bbknn'"))


@query("trk_lift_overall", with_(RUNS, LIFTS) + "SELECT run_id, round(l1, 6) AS lift_macro_f1, round(l2, 6) AS lift_balanced_accuracy FROM lifts WHERE match_status = 'matched'")
def trk_lift_overall(spark: S, d: str) -> DataFrame:
    return rounded(lifts(spark, d).filter("match_status = 'matched'").select("run_id", "lift_macro_f1", "lift_balanced_accuracy"))


_SUMMARY = ", sm AS (SELECT model, graph, count(l1) AS runs, avg(l1) AS mean, coalesce(stddev_samp(l1), 0) AS sd, min(l1) AS least, max(l1) AS most FROM lifts WHERE match_status = 'matched' GROUP BY 1, 2) SELECT model, graph, runs, round(mean, 6) AS mean, round(sd, 6) AS sd, round(least, 6) AS least, round(most, 6) AS most FROM sm"


@query("agg_group_mean_std", with_(RUNS, LIFTS) + _SUMMARY)
def agg_group_mean_std(spark: S, d: str) -> DataFrame:
    return rounded(T.seed_summary(lifts(spark, d).filter("match_status = 'matched'"), ["model", "graph"], "lift_macro_f1"))


@query("snk_lift", with_(RUNS, LIFTS) + _SUMMARY)
def snk_lift(spark: S, d: str) -> DataFrame:
    df = agg_group_mean_std(spark, d)
    return spark.read.schema(df.schema).json(files.write_table(df, "json"))


_TIDY = ", m AS (SELECT run_id, seed, unnest(['macro_f1', 'balanced_accuracy']) AS metric_name, unnest([macro_f1, balanced_accuracy]) AS metric_value FROM runs) SELECT * FROM m"


@query("trk_unpivot", with_(RUNS) + _TIDY)
def trk_unpivot(spark: S, d: str) -> DataFrame:
    return T.tidy(X.runs(spark, d), ["run_id", "seed"], ["macro_f1", "balanced_accuracy"])


@query("snk_tidy", with_(RUNS) + _TIDY)
def snk_tidy(spark: S, d: str) -> DataFrame:
    df = trk_unpivot(spark, d)
    return spark.read.schema(df.schema).option("header", True).csv(files.write_table(df, "csv"))


@query("trk_to_frame", with_(RUNS) + "SELECT run_id, model, graph, seed, macro_f1, 'success' AS status, CAST(NULL AS VARCHAR) AS error_type FROM runs")
def trk_to_frame(spark: S, d: str) -> DataFrame:
    return X.runs(spark, d).select("run_id", "model", "graph", "seed", "macro_f1", "status", F.lit(None).cast("string").alias("error_type"))


@query("trk_run_table", with_(RUNS) + "SELECT run_id, macro_f1, balanced_accuracy FROM runs")
def trk_run_table(spark: S, d: str) -> DataFrame:
    """One line a run, out of the tidy table."""
    pick = lambda m: F.max(F.when(F.col("metric_name") == m, F.col("metric_value"))).alias(m)
    return trk_unpivot(spark, d).groupBy("run_id").agg(pick("macro_f1"), pick("balanced_accuracy"))


def _strata(spark: S, d: str, key: str) -> DataFrame:
    """Lifts of the vote over the centroid in each stratum."""
    one = lambda kind, p: E.summary(E.per_class(p, classes(spark, d), [key]), [key]).select(F.lit(kind).alias("run_id"), key, F.col("observed_f1").alias("value"))
    both = one("graph", X.predictions(spark, d, "vote").filter("part = 'test'")).unionByName(one("base", test(spark, d)))
    pair = spark.createDataFrame([("graph", "base", "matched")], "run_id string, baseline_run_id string, match_status string")
    return T.strata_lifts(both, pair, key)


def _strata_sql(key: str) -> str:
    one = lambda name, of: f"g_{name} AS (SELECT {key} AS g, y, yhat FROM {of} WHERE part = 'test'), w_{name} AS (SELECT g, c AS y, count(*) FILTER (y = c) AS s, count(*) FILTER (yhat = c) AS p, count(*) FILTER (y = c AND yhat = c) AS h FROM g_{name}, cl GROUP BY 1, 2), o_{name} AS (SELECT g, avg(2 * h / (s + p)) FILTER (s > 0) AS f FROM w_{name} GROUP BY 1)"
    return with_(NODES, CENTROID, knn(20), edges(), VOTE, "cl AS (SELECT DISTINCT y AS c FROM nodes)", one("a", "vote"), one("b", "pred")) + f"SELECT 'graph' AS run_id, a.g AS {key}, round(a.f - b.f, 6) AS lift FROM o_a a JOIN o_b b USING (g)"


@query("trk_lift_site", _strata_sql("site"))
def trk_lift_site(spark: S, d: str) -> DataFrame:
    return rounded(_strata(spark, d, "site"))


@query("trk_lift_donor", _strata_sql("donor"))
def trk_lift_donor(spark: S, d: str) -> DataFrame:
    return rounded(_strata(spark, d, "donor"))


@query("join_strata", _strata_sql("donor"))
def join_strata(spark: S, d: str) -> DataFrame:
    return rounded(_strata(spark, d, "donor"))


_ONE = lambda name, of: f"w_{name} AS (SELECT c AS y, count(*) FILTER (y = c) AS s, count(*) FILTER (yhat = c) AS p, count(*) FILTER (y = c AND yhat = c) AS h FROM {of}, cl WHERE part = 'test' GROUP BY 1)"


@query("trk_lift_class", with_(NODES, CENTROID, knn(20), edges(), VOTE, "cl AS (SELECT DISTINCT y AS c FROM nodes)", _ONE("a", "vote"), _ONE("b", "pred")) + "SELECT y, round(CASE WHEN a.s + a.p = 0 THEN 0 ELSE 2 * a.h / (a.s + a.p) END - CASE WHEN b.s + b.p = 0 THEN 0 ELSE 2 * b.h / (b.s + b.p) END, 6) AS lift FROM w_a a JOIN w_b b USING (y)")
def trk_lift_class(spark: S, d: str) -> DataFrame:
    c = classes(spark, d)
    a = E.per_class(X.predictions(spark, d, "vote").filter("part = 'test'"), c).select("y", "f1")
    b = E.per_class(test(spark, d), c).select("y", F.col("f1").alias("base"))
    return a.join(b, "y").select("y", r6(F.col("f1") - F.col("base")).alias("lift"))


@query("trk_validate", with_(CELLS, SPLIT, NODES, knn(20), edges(), RUNS) + """SELECT * FROM (
SELECT 'split' AS category, 'site_stratified' AS name, count(*) AS rows, CAST(0 AS BIGINT) AS disallowed, true AS passed FROM split
UNION ALL SELECT 'features', 'nodes', count(*), 0, true FROM nodes
UNION ALL SELECT 'graph', 'pca_knn_k20', count(*), 0, true FROM edges
UNION ALL SELECT 'graph', 'reversed', count(*), count(*) FILTER (s.part <> 'train'), false FROM edges e JOIN nodes s ON s.node = e.dst
UNION ALL SELECT 'graph', 'bbknn', 0, 0, false
UNION ALL SELECT 'runs', 'all', count(*), count(*) FILTER (macro_f1 IS NULL OR macro_f1 < 0 OR macro_f1 > 1), true FROM runs)""")
def trk_validate(spark: S, d: str) -> DataFrame:
    """The checklist over written artifacts: sound ones, a graph whose edges are turned round, and one that is missing."""
    n = X.nodes(spark, d)
    e = written(pca_knn(n, 20), "edges")
    home = fresh(spark, "artifacts")
    files.write_split(donor_split(X.cells(spark, d)), f"{home}/split/site_stratified")
    files.write_bundle(n, f"{home}/features/nodes")
    artifacts.write_graph_bundle(e, n, "pca_knn_k20", f"{home}/graph/pca_knn_k20")
    artifacts.write_graph_bundle(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"), n, "reversed", f"{home}/graph/reversed")
    files.write_runs(X.runs(spark, d), f"{home}/runs/all")
    return artifacts.validated(spark, home, {"split": ["site_stratified"], "features": ["nodes"], "graph": ["pca_knn_k20", "reversed", "bbknn"], "runs": ["all"]})


@query("trk_repro", with_(NODES, knn(20), edges()) + f"SELECT {content_sql('src', 'dst')} AS content, true AS same FROM edges")
def trk_repro(spark: S, d: str) -> DataFrame:
    """Builds the graph twice, the second time from rows dealt otherwise, and compares the contents' hashes."""
    n = X.nodes(spark, d)
    sums = [pca_knn(df, 20).agg(edge_hash().alias("content")) for df in (n, n.repartition(3, "y"))]
    return sums[0].crossJoin(sums[1].withColumnRenamed("content", "again")).select("content", (F.col("content") == F.col("again")).alias("same"))  # two rows of one


_GRID = "g AS (SELECT i AS c, 'w' || (i % 2) AS class_weight, CAST((i * 37) % 10 AS DOUBLE) / 10 AS val_macro_f1 FROM (SELECT n_nationkey AS i FROM nation))"


@query("top1_grid", with_(_GRID) + "SELECT c, class_weight, val_macro_f1 FROM g ORDER BY val_macro_f1 DESC, c, class_weight DESC LIMIT 1")
def top1_grid(spark: S, d: str) -> DataFrame:
    n = X.read(spark, d, "nation").select(F.col("n_nationkey").alias("c"), F.concat(F.lit("w"), F.pmod("n_nationkey", F.lit(2)).cast("string")).alias("class_weight"), (F.pmod(F.col("n_nationkey") * 37, F.lit(10)).cast("double") / 10).alias("val_macro_f1"))
    return M.top1_grid(n)


@query("top1_epoch", "WITH e AS (SELECT n_nationkey AS epoch, CAST((n_nationkey * 7) % 13 AS DOUBLE) AS score FROM nation), r AS (SELECT *, max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e), b AS (SELECT *, before IS NULL OR score > before AS better FROM r), g AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch) AS gap FROM b), s AS (SELECT coalesce(min(epoch) FILTER (gap >= 5), 999) AS stop FROM g) SELECT max(epoch) FILTER (better) AS best_epoch, least(any_value(stop), max(epoch)) AS last_epoch FROM g, s WHERE epoch <= stop")
def top1_epoch(spark: S, d: str) -> DataFrame:
    """The earliest epoch of the best score, with patience 5."""
    e = X.read(spark, d, "nation").select(F.col("n_nationkey").alias("epoch"), F.pmod(F.col("n_nationkey") * 7, F.lit(13)).cast("double").alias("score"))
    w = W.orderBy("epoch")
    before = F.max("score").over(w.rowsBetween(W.unboundedPreceding, -1))
    b = e.withColumn("better", before.isNull() | (F.col("score") > before))
    g = b.withColumn("gap", F.col("epoch") - F.max(F.when(F.col("better"), F.col("epoch"))).over(w))
    stop = g.agg(F.coalesce(F.min(F.when(F.col("gap") >= 5, F.col("epoch"))), F.lit(999)).alias("stop"))
    return g.crossJoin(stop).filter("epoch <= stop").agg(F.max(F.when(F.col("better"), F.col("epoch"))).alias("best_epoch"), F.least(F.max("stop"), F.max("epoch")).alias("last_epoch"))


@query("model_lr")
def model_lr(spark: S, d: str) -> DataFrame:
    """Predictions of the best of the grid of four C's and two class weights."""
    n = written(X.nodes(spark, d), "nodes")
    return n.select("node", "y", "donor", "site", "part").join(M.classifier("logistic_regression").fit(n).predict(n), "node")


def _model(name: str, kind: str, graph: str) -> None:
    @query(name)
    def run(spark: S, d: str) -> DataFrame:
        n = written(X.nodes(spark, d), "nodes")
        graphs = {} if kind == "mlp" else {graph: written(bbknn(n, 2) if graph == "bbknn" else pca_knn(n, 20, weighted=graph.endswith("rbf")), "edges")}
        return M.sweep(n, graphs, [(kind, graph, 42)])


_model("model_mlp", "mlp", "none")
_model("model_gcn", "gcn", "pca_knn_k20")
_model("model_sage", "graphsage", "bbknn")
_model("model_gcn_weighted", "gcn", "pca_knn_k20_rbf")


@query("model_api")
def model_api(spark: S, d: str) -> DataFrame:
    """(model, node, yhat, prob, saved): each model through fit, save, load, predict_proba and predict; saved says whether the loaded
    model predicts as the fitted one does."""
    n = written(X.nodes(spark, d), "nodes")
    e = written(pca_knn(n, 20), "edges")
    out = None
    for name in sorted(M.MODELS):
        model = M.classifier(name)
        edges = Prepared(name, n, e) if model.graph else None
        path = fresh(spark, f"model-{name}")
        model.fit(n, edges).save(spark, path)
        again = M.load(spark, path)
        one = again.predict(n, edges).join(again.predict_proba(n, edges), "node").join(model.predict(n, edges).withColumnRenamed("yhat", "was"), "node")
        one = one.select(F.lit(name).alias("model"), "node", "yhat", "prob", (F.col("was") == F.col("yhat")).alias("saved"))
        out = one if out is None else out.unionByName(one)
        if edges:
            edges.close()  # what a graph gives is written
    return out


@query("model_sweep")
def model_sweep(spark: S, d: str) -> DataFrame:
    """Test macro-F1 of each (model, graph, seed)."""
    n = written(X.nodes(spark, d), "nodes")
    graphs = {"pca_knn_k20": written(pca_knn(n, 20), "edges"), "bbknn": written(bbknn(n, 2), "edges")}
    grid = [(m, g, s) for m, g in (("mlp", "none"), ("gcn", "pca_knn_k20"), ("graphsage", "bbknn")) for s in (7, 17, 42, 73, 101)]
    p = written(M.sweep(n, graphs, grid).filter("part = 'test'").drop("prob"), "sweep")
    by = ["model", "graph", "seed"]
    return E.summary(E.per_class(p, n.select("y").distinct(), by), by)
