"""Registered queries do the whole job: no fewer rounds, genes, seeds or epochs than the study's."""

import pytest

from vicinal.operators import graph as G
from vicinal.queries import QUERIES, graphs, scores


def test_rewired_query_has_no_rounds(spark, sf, monkeypatch):
    asked = {}
    monkeypatch.setattr(graphs.G, "rewired", lambda edges, nodes, **rules: asked.update(rules) or edges)
    QUERIES["graph_rewired"](spark, sf)
    assert asked == {}


def test_rewired_counts_swaps(spark, monkeypatch):
    seen, plain = [], G.written

    def spy(df, name):
        out = plain(df, name)
        seen.append({(r.src, r.dst, r.kind) for r in out.collect()})
        return out

    monkeypatch.setattr(G, "written", spy)
    part = lambda i: "train" if i < 30 else "val"
    nodes = spark.createDataFrame([(i, part(i)) for i in range(40)], "node long, part string")
    edges = spark.createDataFrame([(i, (i + s) % 30) for i in range(30) for s in (1, 2, 3, 5)] + [(i, 30 + (i * s) % 10) for i in range(30) for s in (1,)] + [(0, 35)], "src long, dst long").distinct()
    out = G.rewired(edges, nodes, factor=2)
    assert {(r.src, r.dst, r.kind) for r in out.collect()} == seen[-1] and out.columns == ["src", "dst", "kind"]
    for kind in ("train->train", "train->val"):
        own = [{e for e in s if e[2] == kind} for s in seen]
        assert sum(len(b - a) // 2 for a, b in zip(own, own[1:])) >= 2 * len(own[0])


@pytest.mark.parametrize("name", ["model_mlp", "model_gcn", "model_sage", "model_sweep"])
def test_networks_train_to_the_end(spark, sf, monkeypatch, name):
    asked, done = [], RuntimeError("enough")

    def sweep(nodes, graphs, grid, **rules):
        asked.append((grid, rules))
        raise done

    monkeypatch.setattr(scores.M, "sweep", sweep)
    with pytest.raises(RuntimeError, match="enough"):
        QUERIES[name](spark, sf)
    assert asked[0][1] == {} and {s for _, _, s in asked[0][0]} == ({7, 17, 42, 73, 101} if name == "model_sweep" else {42})


def test_whole_grid(spark, sf, monkeypatch):
    asked = []
    done = RuntimeError("enough")

    def grid(nodes, cs, weights, iterations):
        asked.append((cs, weights, iterations))
        raise done

    monkeypatch.setattr(scores.M, "logistic_grid", grid)
    with pytest.raises(RuntimeError, match="enough"):
        QUERIES["model_lr"](spark, sf)
    assert asked == [((0.01, 0.1, 1.0, 10.0), ("none", "balanced"), 1000)]


def test_settings_of_the_networks():
    from vicinal.config import ModelConfig

    of = lambda n: (lambda c: (c.hidden, c.dropout, c.rate, c.decay, c.batch, c.epochs, c.patience))(ModelConfig.default(n))
    assert of("mlp") == ((128, 128), 0.3, 1e-3, 1e-4, 256, 500, 50)
    assert of("gcn") == of("graphsage") == ((128,), 0.2, 1e-3, 1e-4, 256, 500, 50)


def test_all_genes_and_components(spark, sf):
    got = QUERIES["pre_pca_fit"](spark, sf)
    genes, components = (got.select(c).distinct().count() for c in ("gene", "component"))
    assert genes > 50 and components == 50


def test_totals_without_dense_rows(spark, sf):
    from pyspark.sql import functions as F

    from vicinal.operators import preprocessing as P
    from vicinal.plans import fixtures as X
    from vicinal.session import written

    cells = X.cells(spark, sf)
    v = written(P.log_normalised(X.counts(spark, sf)).select("cell_id", "gene_id", "v"), "values")
    stats = written(P.gene_moments(v, cells.filter("donor_id < 12").select("cell_id")), "stats")
    for clip in (10.0, 0.5, None):
        dense = {r.cell_id: sum(r.x) for r in P.feature_rows(v, cells, stats, clip).collect()}
        got = P.scaled_totals(v, cells, stats, clip).collect()
        assert len(got) == len(dense) and all(abs(r.total - dense[r.cell_id]) < 1e-6 * (1 + abs(r.total)) for r in got)
    assert P.scaled_totals(v, cells, stats.limit(0)).agg(F.sum("genes")).first()[0] == 0
