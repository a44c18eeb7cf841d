"""Classifiers behind one surface: fit, predict, predict_proba, save, load.

Logistic regression is Spark ML's; the networks (MLP, GCN, GraphSAGE) are trained by `training`, over partitions. All learn from training
nodes, are selected by validation macro-F1, and never see labels of test nodes; what a network without a graph is given can't hold edges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.config import ModelConfig
from vicinal.functions.arrays import matrix
from vicinal.operators import training as T
from vicinal.operators.evaluation import per_class, summary

Params = T.Params


def logistic_grid(nodes: DataFrame, cs: tuple[float, ...] = ModelConfig.cs, weights: tuple[str, ...] = ModelConfig.class_weights, iterations: int = ModelConfig.iterations) -> tuple[LogisticRegressionModel, DataFrame]:
    """(model, grid): an L2 logistic regression for each C and class weight, the best by validation macro-F1 (classes seen in
    truth or prediction); ties go to the first of the grid. Spark penalises the mean loss, so regParam is 1 / (C * sum of
    weights)."""
    v = nodes.withColumn("v", array_to_vector("x"))
    train = v.filter("part = 'train'")
    n = train.groupBy("y").agg(F.count("*").alias("m"))
    total = train.agg(F.count("*").alias("n"), F.count_distinct("y").alias("k")).first()
    weighed = train.join(F.broadcast(n), "y").withColumns({"none": F.lit(1.0), "balanced": F.lit(float(total.n)) / (F.lit(total.k) * F.col("m"))}).cache()
    best, rows, fitted = -1.0, [], None
    for c in cs:
        for w in weights:
            model = LogisticRegression(featuresCol="v", labelCol="y", weightCol=w, family="multinomial", regParam=1 / (c * total.n), standardization=False, maxIter=iterations).fit(weighed)
            val = model.transform(v.filter("part = 'val'")).select("y", F.col("prediction").cast("int").alias("yhat"))
            seen = val.select("y").union(val.select(F.col("yhat").alias("y"))).distinct()
            f1 = summary(per_class(val, seen)).first().macro_f1 or 0.0
            rows.append((c, w, f1))
            if f1 > best:
                best, fitted = f1, model
    weighed.unpersist()
    return fitted, nodes.sparkSession.createDataFrame(rows, "c double, class_weight string, val_macro_f1 double")


def top1_grid(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.desc("val_macro_f1"), "c", F.desc("class_weight")).limit(1)


def macro_f1(y: np.ndarray, p: np.ndarray) -> float:
    k = int(max(y.max(initial=0), p.max(initial=0))) + 1
    return T.f1_of(T.confusion_of(y, p, k))


def _config(kind: str, rules: dict[str, Any]) -> ModelConfig:
    return ModelConfig.of(ModelConfig.default(kind).plain() | rules)


def sweep(nodes: DataFrame, graphs: dict[str, DataFrame], grid: list[tuple[str, str, int]], **rules: Any) -> DataFrame:  # noqa: ANN401
    """(model, graph, seed, node, y, yhat, prob, part, donor, site, epochs) of every (model, graph, seed): all seeds of a model and graph
    are trained in the same passes, each with its own early stop, and predict in one.

    Settings are those of ModelConfig, `rules` replaces some. Edges with a column `weight` are weighted in a GCN.
    """
    typed = nodes.select(F.col("node").cast("long").alias("node"), "x", F.col("y").cast("int").alias("y"), "part", F.col("donor").cast("long").alias("donor"), F.col("site").cast("string").alias("site"))
    k, out = T.classes_of(typed), None
    for model, graph in dict.fromkeys((m, g) for m, g, _ in grid):
        conf, seeds = _config(model, rules), [s for m, g, s in grid if (m, g) == (model, graph)]
        if model == "mlp":
            runs = T.fit_layers(typed, conf, seeds, k)
            prob = T.layers_probas(typed, [r.kept for r in runs])
        else:
            prepared = T.Prepared(model, typed, graphs[graph])
            runs = T.fit_graph(typed, graphs[graph], conf, seeds, k, prepared)
            prob = T.graph_proba(typed, graphs[graph], model, [r.kept for r in runs], prepared)
            prepared.close()
        each = F.explode(F.array(*(F.struct(F.lit(r.seed).alias("seed"), F.slice("prob", 1 + i * k, k).alias("prob"), F.lit(len(r.curve)).alias("epochs")) for i, r in enumerate(runs))))
        rows = prob.select("node", each.alias("run")).join(typed.drop("x"), "node")
        rows = rows.select(F.lit(model).alias("model"), F.lit(graph).alias("graph"), F.col("run.seed").alias("seed"), "node", "y", _best("run.prob").alias("yhat"), F.col("run.prob").alias("prob"), "part", "donor", "site", F.col("run.epochs").alias("epochs"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _best(prob: str) -> Column:
    return F.array_position(prob, F.array_max(prob)).cast("int") - 1


class Classifier:
    """What every model offers.

    fit(nodes, edges=None): nodes (node, x, y, part) of parts train and val; others are ignored. predict_proba(nodes, edges=None):
    (node, prob); predict: (node, yhat). A graph that is asked for again may be given as `training.Prepared` of the same nodes and edges.
    Before fit both are an error. A model without a graph refuses edges. save(path) writes
    settings and weights, through Spark, to any folder that it reaches; load(spark, path) gives the model back.
    """

    graph = False

    def __init__(self, conf: ModelConfig, seed: int = 42) -> None:
        self.conf, self.seed = conf, seed
        self.params: Params | None = None
        self.curve: list[float] = []

    @property
    def best_epoch(self) -> int:
        return int(np.argmax(self.curve)) + 1 if self.curve else 0

    @property
    def best_val_macro_f1(self) -> float:
        return max(self.curve, default=0.0)

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i + 1, v) for i, v in enumerate(self.curve)], "epoch int, val_macro_f1 double")

    def _allowed(self, edges: DataFrame | T.Prepared | None) -> dict[str, Any]:
        if (edges is not None) != self.graph:
            raise ValueError(f"{self.conf.name} {'needs' if self.graph else 'takes no'} edges")
        if isinstance(edges, T.Prepared) and edges.kind != self.conf.name:
            raise ValueError(f"a graph prepared for {edges.kind} isn't one for {self.conf.name}")
        return {"edges": None, "prepared": edges} if isinstance(edges, T.Prepared) else {"edges": edges} if edges is not None else {}

    def fit(self, nodes: DataFrame, edges: DataFrame | T.Prepared | None = None) -> Classifier:
        graphs = self._allowed(edges)
        # a graph is fitted on the graph of the given nodes: what is sent out to other parts doesn't come back, as those send nothing
        run = (T.fit_graph(nodes, conf=self.conf, seeds=[self.seed], **graphs) if graphs else T.fit_layers(nodes, self.conf, [self.seed]))[0]
        self.params, self.curve = run.kept, run.curve
        return self

    def _take(self, rows: DataFrame) -> None:
        self.params = {r.name: np.array(r.data).reshape(r.shape) for r in rows.collect()}  # a network's weights
        self.curve = self.params.pop("curve").tolist()

    def _fitted(self) -> Params:
        if self.params is None:
            raise RuntimeError("the model isn't fitted: call fit first")
        return self.params

    def predict_proba(self, nodes: DataFrame, edges: DataFrame | T.Prepared | None = None) -> DataFrame:
        p, graphs = self._fitted(), self._allowed(edges)
        return T.graph_proba(nodes.select("node", "x"), kind=self.conf.name, weights=[p], **graphs) if graphs else T.layers_probas(nodes, [p])

    def predict(self, nodes: DataFrame, edges: DataFrame | T.Prepared | None = None) -> DataFrame:
        return self.predict_proba(nodes, edges).select("node", _best("prob").alias("yhat"))

    def save(self, spark: SparkSession, path: str) -> None:
        p = self._fitted() | {"curve": np.array(self.curve)}
        spark.createDataFrame([(k, list(v.shape), v.reshape(-1).tolist()) for k, v in p.items()], WEIGHTS).coalesce(1).write.parquet(f"{path}/weights")
        _save_settings(spark, path, self.conf, self.seed)


WEIGHTS = "name string, shape array<int>, data array<double>"


def _save_settings(spark: SparkSession, path: str, conf: ModelConfig, seed: int) -> None:
    spark.createDataFrame([(json.dumps(conf.plain(), sort_keys=True), conf.sha256(), seed)], "settings string, sha256 string, seed int").coalesce(1).write.json(f"{path}/settings")


class MLP(Classifier):
    def __init__(self, conf: ModelConfig | None = None, seed: int = 42) -> None:
        super().__init__(conf or ModelConfig.default("mlp"), seed)


class GCN(Classifier):
    graph = True

    def __init__(self, conf: ModelConfig | None = None, seed: int = 42) -> None:
        super().__init__(conf or ModelConfig.default("gcn"), seed)


class GraphSAGE(Classifier):
    graph = True

    def __init__(self, conf: ModelConfig | None = None, seed: int = 42) -> None:
        super().__init__(conf or ModelConfig.default("graphsage"), seed)


class Logistic(Classifier):
    """Spark ML's logistic regression over the grid of C and class weights; `grid` is the selection table."""

    def __init__(self, conf: ModelConfig | None = None, seed: int = 42) -> None:
        super().__init__(conf or ModelConfig.default("logistic_regression"), seed)
        self.model: LogisticRegressionModel | None = None
        self.grid: DataFrame | None = None

    def fit(self, nodes: DataFrame, edges: DataFrame | None = None) -> Logistic:
        self._allowed(edges)
        self.model, self.grid = logistic_grid(nodes.filter(F.col("part").isin("train", "val")), self.conf.cs, self.conf.class_weights, self.conf.iterations)
        return self

    def predict_proba(self, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        self._allowed(edges)
        if self.model is None:
            raise RuntimeError("the model isn't fitted: call fit first")
        return self.model.transform(nodes.select("node", array_to_vector("x").alias("v"))).select("node", vector_to_array("probability").alias("prob"))

    def save(self, spark: SparkSession, path: str) -> None:
        if self.model is None:
            raise RuntimeError("the model isn't fitted: call fit first")
        self.model.write().save(f"{path}/weights")
        _save_settings(spark, path, self.conf, self.seed)


class Centroid(Classifier):
    """The class whose mean over training nodes is nearest, ties to the least class; a baseline that SQL can say too."""

    def __init__(self, conf: ModelConfig | None = None, seed: int = 42) -> None:
        super().__init__(conf or ModelConfig.default("centroid"), seed)

    def fit(self, nodes: DataFrame, edges: DataFrame | None = None) -> Centroid:
        self._allowed(edges)
        mean = nodes.filter("part = 'train'").select("y", F.posexplode("x").alias("i", "v")).groupBy("y", "i").agg(F.avg("v").alias("v"))
        rows = mean.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c")).orderBy("y").collect()  # one row a class
        self.params = {"y": np.array([float(r.y) for r in rows]), "c": np.array([r.c for r in rows])}
        return self

    def predict_proba(self, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """1 for the nearest class, 0 for the others; classes are numbers from 0."""
        self._allowed(edges)
        p = self._fitted()
        y, c = p["y"].astype(int), p["c"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("x"))
                    far = np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in c], 1).round(9)
                    hot = np.zeros((len(x), int(y.max()) + 1))
                    hot[np.arange(len(x)), y[far.argmin(1)]] = 1
                    yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(hot))], ["node", "prob"])

        return nodes.select("node", "x").mapInArrow(run, "node long, prob array<double>")


MODELS: dict[str, type[Classifier]] = {"logistic_regression": Logistic, "mlp": MLP, "gcn": GCN, "graphsage": GraphSAGE, "centroid": Centroid}


def classifier(name: str, seed: int = 42, **rules: Any) -> Classifier:  # noqa: ANN401
    if name not in MODELS:
        raise KeyError(f"no model {name}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name](_config(name, rules), seed)


def load(spark: SparkSession, path: str) -> Classifier:
    """The model that save wrote; settings whose hash isn't theirs are an error."""
    row = spark.read.schema("settings string, sha256 string, seed int").json(f"{path}/settings").first()
    conf = ModelConfig.of(json.loads(row.settings))
    if conf.sha256() != row.sha256:
        raise ValueError(f"the settings in {path} were changed")
    model = MODELS[conf.name](conf, row.seed)
    if isinstance(model, Logistic):
        model.model = LogisticRegressionModel.load(f"{path}/weights")
    else:
        model._take(spark.read.schema(WEIGHTS).parquet(f"{path}/weights"))
    return model
