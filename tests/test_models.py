"""The surface that all models share, gradients, and the artifacts' checklist."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators import diagnostics as D
from vicinal.operators import graph as G
from vicinal.operators import models as M
from vicinal.sources import artifacts, records


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        y = i % 3
        x = rng.normal(size=4) + 3 * np.eye(4)[y]
        rows.append((i, x.tolist(), y, i % 6, "S", ("train", "train", "val", "test")[i // 3 % 4]))
    return spark.createDataFrame(rows, "node long, x array<double>, y int, donor long, site string, part string")


@pytest.mark.parametrize("name", sorted(M.MODELS))
def test_fit_predict_save_load(spark, nodes, tmp_path, name):
    model = M.classifier(name, 7, epochs=80, rate=0.01)
    edges = G.pca_knn(nodes, 4) if model.graph else None
    with pytest.raises(RuntimeError, match="fit first"):
        model.predict(nodes, edges)
    with pytest.raises(ValueError, match="edges"):
        model.fit(nodes, None if model.graph else G.pca_knn(nodes, 4))
    got = model.fit(nodes, edges).predict(nodes, edges).join(nodes, "node").filter("part = 'test'")
    assert got.filter("y = yhat").count() > 0.8 * got.count()
    prob = {r.node: r.prob for r in model.predict_proba(nodes, edges).collect()}
    assert len(prob) == 120 and all(abs(sum(p) - 1) < 1e-9 and len(p) == 3 for p in prob.values())
    path = f"file://{tmp_path}/{name}"
    model.save(spark, path)
    again = M.load(spark, path)
    assert {r.node: r.prob for r in again.predict_proba(nodes, edges).collect()} == prob and again.seed == 7
    # labels of test nodes don't matter
    other = M.classifier(name, 7, epochs=80, rate=0.01).fit(nodes.withColumn("y", F.when(F.col("part") == "test", 0).otherwise(F.col("y"))), edges)
    assert all(np.allclose(r.prob, prob[r.node]) for r in other.predict_proba(nodes, edges).collect())


def test_best_epoch_is_kept(spark, nodes):
    model = M.classifier("mlp", 42, hidden=[32], epochs=20, patience=10).fit(nodes)
    curve = [r.val_macro_f1 for r in model.history(spark).collect()]
    assert 0 < model.best_epoch <= len(curve) <= 20 and model.best_val_macro_f1 == max(curve) > 0
    y = nodes.filter("part = 'val'").join(model.predict(nodes), "node").toPandas()
    assert np.isclose(M.macro_f1(y.y.to_numpy(), y.yhat.to_numpy()), max(curve))


def test_weights_change_a_gcn(spark, nodes):
    e = G.pca_knn(nodes, 5, weighted=True)
    run = lambda g: [r.prob for r in M.sweep(nodes, {"g": g}, [("gcn", "g", 1)], epochs=5).orderBy("node").collect()]
    assert run(e) != run(e.drop("weight")) and run(e) == run(e)


def test_messages(spark, nodes):
    edges = G.pca_knn(nodes, 3)
    e = [(r.src, r.dst) for r in edges.collect()]
    x = {r.node: np.array(r.x) for r in nodes.collect()}
    mean = {r.node: r.x for r in D.mean_features(edges.filter("dst <> 5"), nodes).collect()}
    assert mean[5] == [0.0] * 4 and all(np.allclose(mean[n], np.mean([x[a] for a, b in e if b == n], 0)) for n in (0, 1, 7, 119))
    loops = e + [(n, n) for n in x]
    deg = {n: sum(b == n for _, b in loops) for n in x}
    got = {r.node: r.x for r in D.normalised_features(edges, nodes).collect()}
    assert all(np.allclose(got[n], sum(x[a] / np.sqrt(deg[a] * deg[n]) for a, b in loops if b == n)) for n in (0, 3, 50, 119))


def test_manifest_and_checklist(spark, nodes, tmp_path):
    e = G.pca_knn(nodes, 3, weighted=True)
    width = G.sigma(G.knn_train(nodes, 3), 3)
    m = G.manifest(e, nodes, "g", k=3, width=width).first()
    assert (m.num_nodes, m.num_disallowed_edges, m.weighting, m.k) == (120, 0, "rbf", 3) and m.sigma_k > 0
    assert m.num_edges == m.num_train_train_edges + m.num_train_to_val_edges + m.num_train_to_test_edges
    again = G.manifest(e.repartition(5), nodes.repartition(2), "g", k=3, width=width).first()
    assert again == m
    assert G.manifest(e.withColumn("weight", F.col("weight") / 2), nodes, "g").first().weight_hash != m.weight_hash
    assert G.manifest(e.filter("src <> 0"), nodes, "g").first().edge_hash != m.edge_hash
    home = f"file://{tmp_path}"
    artifacts.write_graph_bundle(e, nodes, "g", f"{home}/graph/good")
    artifacts.write_graph_bundle(e, nodes, "g", f"{home}/graph/changed")
    e.limit(1).select("src", "dst", "dist").write.mode("append").parquet(f"{home}/graph/changed/edges")
    got = {r.name: r.passed for r in artifacts.validated(spark, home, {"graph": ["good", "changed", "none"]}).collect()}
    assert got == {"good": True, "changed": False, "none": False}


def test_records_keep_artifacts(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    home = records.save_record(tmp_path / "runs", records.Record("r1", metrics={"f": 1.0}), {"a.txt": tmp_path / "a.txt"})
    assert (home / "artifacts" / "a.txt").read_text() == "x" and records.load_records(tmp_path / "runs")[0].run_id == "r1"
