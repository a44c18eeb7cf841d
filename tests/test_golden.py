"""Cases computed by hand, and what has to hold whatever the data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions.scalars import canon_label, half_even, sha256_of
from vicinal.operators import cells as C
from vicinal.operators import diagnostics as D
from vicinal.operators import evaluation as E
from vicinal.operators import graph as G
from vicinal.operators import models as M
from vicinal.operators import preprocessing as P
from vicinal.operators import tracking as T
from vicinal.operators.splitting import donor_split
from vicinal.sources import files

NODE = "node long, y int, donor string, site string, part string"


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def graph_of(spark, ends, y, donors=None):
    nodes = frame(spark, [(i, c, (donors or ["A"] * len(y))[i], "S", "train") for i, c in enumerate(y)], NODE)
    return frame(spark, ends, "src long, dst long"), nodes


def random_nodes(spark, n=(60, 20, 15), d=6, seed=3):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for part, m in zip(("train", "val", "test"), n, strict=True):
        for _ in range(m):
            rows.append((i, rng.normal(size=d).tolist(), int(rng.integers(3)), i % 3 if part == "train" else 9, "S", part))
            i += 1
    return frame(spark, rows, "node long, x array<double>, y int, donor long, site string, part string")


def test_library_size_and_log(spark):
    counts = frame(spark, [(0, "a", 10), (0, "b", 20), (0, "c", 30), (1, "a", 100), (1, "b", 200), (1, "c", 100), (2, "a", 0)], "cell_id long, gene_id string, n long")
    got = {(r.cell_id, r.gene_id): r.v for r in P.log_normalised(counts, 1000).collect()}
    assert got[0, "b"] == pytest.approx(math.log1p(20 * 1000 / 60)) and got[2, "a"] == 0


def test_scaling_counts_absent_values_as_zero(spark):
    values = frame(spark, [(0, "a", 2.0), (1, "a", 4.0), (0, "b", 5.0), (1, "b", 5.0), (2, "b", 5.0), (9, "a", 99.0)], "cell_id long, gene_id string, v double")
    cells = frame(spark, [(0,), (1,), (2,)], "cell_id long")
    stats = P.gene_moments(values, cells)
    got = {r.gene_id: (r.mean, r.sd) for r in stats.collect()}
    assert got["a"] == (2.0, pytest.approx(math.sqrt(8 / 3))) and got["b"] == (5.0, 1.0)
    z = {(r.cell_id, r.gene_id): r.z for r in P.scaled(values, cells, stats).collect()}
    assert len(z) == 6 and z[2, "a"] == pytest.approx(-2 / math.sqrt(8 / 3)) and z[0, "b"] == 0
    assert max(abs(r.z) for r in P.scaled(values, cells, stats, 0.5).collect()) == 0.5


def test_dispersion_bins_and_single_genes(spark):
    rng = np.random.default_rng(0)
    rows = [(c, f"g{g:02d}", math.log1p(rng.gamma(1 + g % 5))) for c in range(40) for g in range(30)] + [(c, "g99", math.log1p(900 + c % 2)) for c in range(40)]
    got = {r.gene_id: r for r in P.gene_dispersions(frame(spark, rows, "cell_id long, gene_id string, v double"), frame(spark, [(c,) for c in range(40)], "cell_id long")).collect()}
    assert got["g99"].bin == 20 and got["g99"].score == 1.0 and min(r.bin for r in got.values()) == 1


def test_pca_is_orthonormal_and_fitted_on_train_only(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    feats = lambda a: frame(spark, [(i, v.tolist()) for i, v in enumerate(a)], "cell_id long, x array<double>")
    train = frame(spark, [(i,) for i in range(40)], "cell_id long")
    model, rows = P.pca(feats(x), train, 5)
    pc = model.pc.toArray()
    assert np.allclose(pc.T @ pc, np.eye(5), atol=1e-8)
    got = np.array([r.pc for r in rows.orderBy("cell_id").collect()])
    assert np.allclose(got[:40].mean(0), 0, atol=1e-9) and np.allclose(got, (x - x[:40].mean(0)) @ pc, atol=1e-8)
    y = x.copy()
    y[40:] += 100
    assert np.allclose(np.abs(P.pca(feats(y), train, 5)[0].pc.toArray()), np.abs(pc))


def test_homophily_and_mixing(spark):
    full = [(a, b) for a in range(4) for b in range(4) if a != b]
    ends = D.attributed(*graph_of(spark, full, [0, 0, 0, 0]))
    assert D.edge_homophily(ends).first().overall == 1.0 and D.node_homophily(D.node_purity(ends)).first().overall == 1.0
    e, n = graph_of(spark, [(0, 1), (1, 0), (2, 3), (3, 2), (0, 2), (2, 0), (1, 3), (3, 1)], [0, 0, 1, 1])
    ends = D.attributed(e, n)
    assert D.edge_homophily(ends).first().train == 0.5 and D.expected(n).first().overall == 0.5
    assert {r.y: r.purity for r in D.class_purity(D.node_purity(ends), n).collect()} == {0: 0.5, 1: 0.5}
    e, n = graph_of(spark, [(0, 0), (1, 0), (0, 2), (2, 2)], [0, 0, 1, 1], ["A", "A", "B", "B"])
    ends = D.attributed(e, n)
    assert D.mixing(ends).first().intra_donor == 0.75
    bits = {r.node: round(r.bits, 6) for r in D.entropy(ends, n, "donor").collect()}
    assert bits == {0: 0, 1: 0, 2: 1, 3: 0} and round(D.entropy_summary(D.entropy(ends, n, "donor")).first().bits, 6) == 0.25


def test_components_and_lone_nodes(spark):
    e, n = graph_of(spark, [(i, i + 1) for i in range(40)] + [(50, 51)], [0] * 55)
    got = {r.node: r.comp for r in D.components(e, n).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[51] == 50 and got[54] == 54 and got[45] == 45
    assert D.isolated(D.degrees(e, n)).first().isolated == 12


def test_split_of_23_donors(spark):
    rows = [(s * 1000 + d * 40 + c, f"{'CN'[s]}{d:02d}", "CN"[s], f"t{c % 12}") for s, n in ((0, 12), (1, 11)) for d in range(n) for c in range(40)]
    cells = frame(spark, rows, "cell_id long, donor_id string, site string, cell_type string")
    split = donor_split(cells)
    assert {r.part: r.n for r in split.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"train": 12, "val": 6, "test": 5}
    assert C.overlaps(split, "donor_id").count() == 0 and split.count() == 23
    support = C.crosstab(cells.join(split.select("donor_id", "part"), "donor_id"), "cell_type", "part", ["train", "val", "test"])
    assert support.agg(F.sum("total")).first()[0] == 920 and C.rare_classes(support, 10_000).count() == 12
    with pytest.raises(Exception, match="three donors"):
        donor_split(cells.filter("donor_id in ('C00', 'C01')")).collect()


@pytest.mark.parametrize("check,cells,counts", [("unique_id", [(1, 1, "a"), (1, 1, "a")], []), ("nulls", [(1, None, "a")], []), ("nulls", [(1, 1, None)], []), ("counts", [(1, 1, "a")], [(1, "g", -5.0)]), ("counts", [(1, 1, "a")], [(1, "g", 1.5)]), ("min_cells", [(1, 1, "a")], []), ("nonempty", [], [])])
def test_defects_are_found(spark, check, cells, counts):
    c, n = frame(spark, cells, "cell_id long, donor_id int, cell_type string"), frame(spark, counts, "cell_id long, gene_id string, n double")
    got = {r.check: r.bad for r in C.violations(c, n, least=2).collect()}
    assert got[check] == 1


def test_evaluation(spark):
    rows = [(0, 0, "d1", "C"), (0, 1, "d1", "C"), (1, 1, "d2", "N"), (1, 1, "d2", "N"), (0, 0, "d3", "C"), (1, 0, "d3", "N")]
    p = frame(spark, rows, "y int, yhat int, donor string, site string")
    classes = p.select("y").distinct()
    assert E.summary(E.per_class(p, classes)).first().macro_f1 == pytest.approx(2 / 3)
    site = {r.site: r for r in E.summary(E.per_class(p, classes, ["site"]), ["site"]).collect()}
    assert site["C"].observed_f1 == pytest.approx(0.8) and site["C"].macro_f1 == pytest.approx(0.4) and site["N"].observed_f1 == pytest.approx(0.8)
    donor = {r.donor: r for r in E.summary(E.per_class(p, classes, ["donor"]), ["donor"]).collect()}
    assert donor["d1"].observed_f1 == pytest.approx(2 / 3) and donor["d2"].macro_f1 == 0.5 and donor["d3"].macro_f1 == pytest.approx(1 / 3)
    lists = {r.donor: (r.present, r.absent) for r in E.label_lists(p, classes, "donor").collect()}
    assert lists["d2"] == ([1], [0])
    assert {(r.y, r.yhat): r.n for r in E.confusion(p, classes).collect()} == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2}


def test_lift_and_mismatch(spark):
    from vicinal.schemas import RUN

    run = lambda i, m, s, h, f: (i, m, "g", s, "d", "1", "s", "h", "f", h, "l", "success", f, f)
    runs = frame(spark, [run("a", "mlp", 1, "p", 0.5), run("b", "gcn", 1, "p", 0.75), run("c", "gcn", 2, "p", 0.9), run("e", "gcn", 1, "q", 0.9)], RUN)
    got = {r.run_id: r for r in T.matched(runs, "mlp").collect()}
    assert got["b"].lift_macro_f1 == 0.25 and got["c"].match_status == "unmatched" and got["e"].differ == "preprocessing_hash" and got["e"].lift_macro_f1 is None
    with pytest.raises(Exception, match="preprocessing_hash"):
        T.matched(runs, "mlp", strict=True).collect()
    s = T.seed_summary(T.matched(runs, "mlp").filter("match_status = 'matched'"), ["model"], "lift_macro_f1").first()
    assert (s.mean, s.sd, s.runs) == (0.25, 0.0, 1)


def test_neighbours_in_blocks_as_resident(spark, monkeypatch):
    nodes = random_nodes(spark)
    train = nodes.filter("part = 'train'")
    key = lambda df: sorted((r.dst, r["rank"], r.src) for r in df.collect())
    whole, grouped = key(G.nearest(nodes, train, 4)), key(G.nearest(nodes, train, 2, "donor"))
    monkeypatch.setattr(G, "RESIDENT", 0)
    monkeypatch.setattr(G, "BLOCK", 13)
    assert key(G.nearest(nodes, train, 4)) == whole and key(G.nearest(nodes, train, 2, "donor")) == grouped
    assert len(grouped) == 95 * 6 and len(whole) == 95 * 4


def test_equal_vectors_are_neighbours_but_not_of_themselves(spark):
    nodes = frame(spark, [(i, [0.0, 0.0], 0, 0, "S", "train") for i in range(5)], "node long, x array<double>, y int, donor long, site string, part string")
    got = G.knn_train(nodes, 2).collect()
    assert all(r.src != r.dst for r in got) and {(r.dst, r.src) for r in got if r.dst == 0} == {(0, 1), (0, 2)}
    with pytest.raises(ValueError, match="more than 5"):
        G.knn_train(nodes, 5)
    assert G.bbknn(nodes, 20).count() == 20


def test_graph_invariants(spark):
    nodes = random_nodes(spark)
    edges = G.pca_knn(nodes, 5, weighted=True)
    assert G.kinds(edges, nodes).filter("kind = 'disallowed'").count() == 0
    w = [r.weight for r in edges.collect()]
    assert all(0 < x <= 1 for x in w)
    m = {(r.src, r.dst) for r in G.mutual(G.knn_train(nodes, 5)).collect()}
    assert m and all((b, a) in m for a, b in m)
    per = G.bbknn(nodes, 2).join(nodes.filter("part = 'test'").select(F.col("node").alias("dst")), "dst").groupBy("dst").count().collect()
    assert all(r["count"] == 6 for r in per)
    assert G.to_data(nodes).filter("part <> 'train' and y <> -1").count() == 0


def test_rewiring_keeps_degrees(spark):
    nodes = random_nodes(spark)
    edges = G.pca_knn(nodes, 5)
    out = G.rewired(edges, nodes, rounds=5)
    before, after = G.kinds(edges, nodes).collect(), out.collect()
    count = lambda rows, c: sorted((r.kind, r[c]) for r in rows)
    assert count(before, "src") == count(after, "src") and count(before, "dst") == count(after, "dst")
    pairs = {(r.src, r.dst) for r in after}
    assert len(pairs) == len(after) and all(a != b for a, b in pairs)
    assert len(pairs & {(r.src, r.dst) for r in before}) < 0.7 * len(pairs)


def test_networks_learn(spark):
    rng = np.random.default_rng(5)
    y = np.repeat([0, 1, 2], 40)
    x = rng.normal(size=(120, 5)) + 2 * np.eye(5)[y]
    part = np.tile([0, 0, 1, 2], 30)
    src = np.concatenate([rng.permutation(np.flatnonzero(y == c)) for c in range(3)])
    dst = np.roll(src, 1)
    names = np.array(["train", "val", "test"])[part]
    nodes = frame(spark, [(i, v.tolist(), int(c), 0, "S", p) for i, (v, c, p) in enumerate(zip(x, y, names, strict=True))], "node long, x array<double>, y int, donor long, site string, part string")
    edges = frame(spark, [(int(a), int(b)) for a, b in zip(src, dst, strict=True)], "src long, dst long")
    for kind in ("mlp", "gcn", "graphsage"):
        given = () if kind == "mlp" else (edges,)
        model = M.classifier(kind, 1, epochs=60, rate=0.01).fit(nodes, *given)
        said = np.array([r.yhat for r in model.predict(nodes, *given).orderBy("node").collect()])
        assert M.macro_f1(y[part == 2], said[part == 2]) > 0.8 and len(model.curve) <= 60
        assert M.macro_f1(y[part == 1], said[part == 1]) == max(model.curve)
        again = M.classifier(kind, 1, epochs=60, rate=0.01).fit(nodes.withColumn("y", F.when(F.col("part") == "test", 0).otherwise(F.col("y"))), *given)
        assert all((again.params[k] == model.params[k]).all() for k in model.params)  # labels of test nodes don't count


def test_sweep_and_logistic(spark):
    nodes = random_nodes(spark)
    got = M.sweep(nodes, {"g": G.pca_knn(nodes, 5)}, [("mlp", "none", 1), ("gcn", "g", 1), ("gcn", "g", 2)], epochs=3)
    assert got.count() == 3 * 95 and got.select("model", "seed").distinct().count() == 3
    model, grid = M.logistic_grid(nodes, (0.1, 1.0), ("none",))
    assert model.numFeatures == 6 and grid.count() == 2 and M.top1_grid(grid).count() == 1


def test_files_and_registries(spark, tmp_path):
    split = frame(spark, [(1, "train"), (2, "val"), (3, "test")], "donor_id int, part string")
    assert sorted(files.read_split(spark, files.write_split(split)).collect()) == sorted(split.collect())
    with pytest.raises(ValueError, match="more than one part"):
        files.read_split(spark, files.write_split(split.union(frame(spark, [(1, "val")], "donor_id int, part string"))))
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"run_id": "a", "seed": 1}\n{broken\n{"run_id": "a", "seed": 1}\n')
    assert [r.run_id for r in files.read_runs(spark, f"file://{tmp_path}/r").collect()] == ["a"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_manifest(spark, f"file://{tmp_path}/none").collect()
    rows = frame(spark, [(1, "train"), (2, "val")], "cell_id long, part string")
    assert files.read_bundle(spark, files.write_bundle(rows), "cell_id long, part string", "val").collect()[0].cell_id == 2
    with pytest.raises(KeyError, match="bbknn"):
        G.builder("none")
    with pytest.raises(ValueError, match="already"):
        G.register_builder("bbknn")(None)
    with pytest.raises(KeyError, match="counts"):
        files.source("none")
    assert G.builder("pca_knn") is G.pca_knn and files.synthetic(spark).collect() == files.synthetic(spark).collect()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="donor_id, cell_type"):
        C.require_columns(frame(spark, [(1,)], "cell_id long"), ["cell_id", "donor_id", "cell_type"])


def test_scalars(spark):
    df = frame(spark, [(" B cell ", 2.5), ("other", 3.5)], "label string, x double")
    got = df.select(canon_label(F.col("label"), {"b cell": "B"}).alias("l"), half_even(F.col("x")).alias("r")).collect()
    assert [(r.l, r.r) for r in got] == [("B", 2.0), ("other", 4.0)]
    assert sha256_of({"b": 1, "a": 2}) == sha256_of({"a": 2, "b": 1})


def test_stream_scores_as_batch(spark, tmp_path):
    from vicinal.streaming.scoring import score, score_stream

    nodes = random_nodes(spark)
    train, ask = nodes.filter("part = 'train'"), nodes.filter("part = 'test'").select("node", "x")
    ask.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(ask.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = score_stream(stream, train, 5, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    assert sorted(spark.read.parquet(f"file://{tmp_path}/out").drop("batch").collect()) == sorted(score(ask, train, 5).collect())


def test_whole_study(spark):
    from vicinal.plans.study import features, gain

    rows = files.synthetic(spark, cells=160, genes=30, donors=10, classes=3).withColumn("site", F.when(F.col("donor_id") < 5, "A").otherwise("B"))
    cells = rows.select("cell_id", "donor_id", "site", "cell_type").distinct()
    nodes = features(rows.select("cell_id", "gene_id", "n"), cells, genes=20, k=5)
    assert nodes.count() == 160
    got = gain(nodes, 5, (7, 17), epochs=10).collect()
    assert len(got) == 6 and all(r.lift == 0 for r in got if r.model == "mlp")
