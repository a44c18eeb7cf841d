"""Neighbours by cells against all pairs, and how many pairs they compare."""

import tracemalloc

import numpy as np
import pytest

from vicinal.operators import graph as G
from vicinal.operators import pivots as P

NODES = "node long, x array<double>, donor long, part string"


def brute(rows, asked, k, group):
    out = set()
    for q in asked:
        by = {}
        for b in rows:
            if b[0] != q[0]:
                by.setdefault(b[2] if group else "", []).append((float(np.sqrt(((np.array(q[1]) - b[1]) ** 2).sum())), b[0]))
        for g, members in by.items():
            out |= {(s, q[0], round(d, 9)) for d, s in sorted(members)[:k]}
    return out


@pytest.mark.parametrize("group", [None, "donor"])
def test_as_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(G, "RESIDENT", 0)
    monkeypatch.setattr(G, "BLOCK", 60)
    monkeypatch.setattr(P, "PER", 20)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, 3)) * 20
    rows = [(i, (centre[i % 8] + rng.normal(size=3)).round(1).tolist(), int(rng.integers(0, 3)), "train") for i in range(400)]
    rows += [(400 + i, [1.0, 2.0, 3.0], 0, "train") for i in range(120)] + [(600, [500.0, 0.0, 0.0], 4, "train"), (601, [500.0, 0.0, 0.0], 5, "train")]
    df = spark.createDataFrame(rows, NODES)
    got = {(r.src, r.dst, round(r.dist, 9)) for r in G.nearest(df, df, 5, group).collect()}
    assert got == brute(rows, rows, 5, group)


def test_far_cells_aren_t_asked(spark, monkeypatch):
    """On clustered data under a fifth of all pairs is compared."""
    monkeypatch.setattr(P, "PER", 25)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 8)) * 10
    rows = [(i, (centre[i % 40] + rng.normal(size=8)).tolist(), 0, "train") for i in range(2000)]
    df = spark.createDataFrame(rows, NODES)
    pairs = []
    real = P.compared
    monkeypatch.setattr(P, "compared", lambda asked, found, *x: pairs.append(sum(int(found.size[r.cell]) * r["count"] for r in asked.groupBy("cell").count().collect())) or real(asked, found, *x))
    monkeypatch.setattr(G, "RESIDENT", 0)
    got = {(r.src, r.dst) for r in G.nearest(df, df, 10).collect()}
    monkeypatch.setattr(G, "RESIDENT", 64 << 20)
    assert got == {(r.src, r.dst) for r in G.nearest(df, df, 10).collect()}
    assert len(pairs) == 2 and sum(pairs) < 0.2 * 2000**2


def test_empty(spark, monkeypatch):
    monkeypatch.setattr(G, "RESIDENT", -1)
    df = spark.createDataFrame([(1, [0.0], 0, "train"), (2, [1.0], 0, "train")], NODES)
    assert G.nearest(df, df.limit(0), 3).count() == 0 and G.nearest(df.limit(0), df, 3).count() == 0
    assert {(r.src, r.dst) for r in G.nearest(df, df, 3).collect()} == {(1, 2), (2, 1)}


def test_distances_held_at_once(monkeypatch):
    """A task's memory doesn't grow with queries times members, and few at a time give the same as all."""
    rng = np.random.default_rng(8)
    x, ids = rng.normal(size=(100_000, 2)), rng.permutation(100_000)
    tracemalloc.start()
    G._nearest(x[:400], ids[:400], None, x, ids, np.zeros(len(x), int), 5)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    x, ids, group = x[:300].round(1), ids[:300], rng.integers(0, 3, 300)
    want = G._nearest(x, ids, None, x, ids, group, 4)
    monkeypatch.setattr(G, "AT_ONCE", 700)
    got = G._nearest(x, ids, None, x, ids, group, 4)
    assert len(want[0]) == 300 * 3 * 4 and sorted(zip(*want, strict=True)) == sorted(zip(*got, strict=True))


@pytest.mark.parametrize("group", [None, "donor"])
def test_where_cells_rule_nothing_out_queries_go_once_a_block(spark, monkeypatch, group):
    """Without clusters a query's vector was sent once a cell: over 615,384 vectors that was 49 million vectors."""
    monkeypatch.setattr(G, "RESIDENT", 0)
    monkeypatch.setattr(G, "BLOCK", 90)
    monkeypatch.setattr(P, "PER", 10)
    monkeypatch.setattr(P, "LARGE", 100 * 6 * 8)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist(), int(rng.integers(0, 3)), "train") for i in range(300)]
    df = spark.createDataFrame(rows, NODES)
    sent, real = [], P.compared
    monkeypatch.setattr(P, "compared", lambda asked, *x: sent.append(asked.count()) or real(asked, *x))
    got = {(r.src, r.dst, round(r.dist, 9)) for r in G.nearest(df, df, 5, group).collect()}
    assert got == brute(rows, rows, 5, group) and sent[1] == 300


def test_single_precision_only_where_it_tells_vectors_apart():
    rng = np.random.default_rng(10)
    for x in (rng.normal(size=(200, 5)) * 1e-3 + 1e4, rng.normal(size=(200, 5)) * 1e-20, rng.normal(size=(200, 5)) * 1e20, np.repeat(rng.normal(size=(10, 5)), 20, 0)):
        got = G._nearest(x, np.arange(200), None, x, np.arange(200), np.zeros(200, int), 4)
        dist = np.sqrt(((x[:, None] - x) ** 2).sum(2))
        np.fill_diagonal(dist, np.inf)
        assert sorted(zip(*(c.tolist() for c in got[:2]), strict=True)) == sorted((i, int(j)) for i in range(200) for j in np.lexsort((np.arange(200), dist[i]))[:4])


def test_a_tile_of_distances_is_held():
    """A query's distances to all members were held at once, in several copies: over 20 MB for these."""
    rng = np.random.default_rng(11)
    x, ids = rng.normal(size=(100_000, 2)), np.arange(100_000)
    own = G._itself(ids, ids[:256])
    v, low, norm = (-2 * x[:256]).astype(np.float32), x.astype(np.float32), np.einsum("ij,ij->i", x, x).astype(np.float32)
    tracemalloc.start()
    i, j = G._close(v, low, norm, own, 5, 1e-5)
    assert tracemalloc.get_traced_memory()[1] < 12 << 20 and len(i) <= 8 * 5 * 256
    tracemalloc.stop()
    dist = ((x[:20, None] - x) ** 2).sum(2)
    dist[np.arange(20), np.arange(20)] = np.inf
    pairs = set(zip(i.tolist(), j.tolist(), strict=True))
    assert {(q, int(m)) for q in range(20) for m in np.argsort(dist[q])[:5]} <= pairs and not any(q == m for q, m in pairs)


@pytest.mark.parametrize("size", [3, 40, 2_047, 2_049, 6_000])
@pytest.mark.parametrize("k", [1, 6, 50])
def test_neighbours_wherever_they_stand(size, k):
    """Nearest members side by side, a run apart, at the ends of tiles, or all alike."""
    base = np.arange(size, dtype=float)
    for order in (base, base[::-1], (base * 7919) % size, base % G.RUN, base // G.COLUMNS, base * 0):
        x, ids = np.stack([order, order * 0.5], 1), np.arange(size)
        got = G._nearest(x[:9], ids[:9], None, x, ids, ids * 0, k)
        dist = np.sqrt(((x[:9, None] - x) ** 2).sum(2))
        dist[np.arange(min(9, size)), np.arange(min(9, size))] = np.inf
        want = [(i, int(j)) for i in range(min(9, size)) for j in np.lexsort((ids, dist[i]))[: min(k, size - 1)]]
        assert list(zip(*(c.tolist() for c in got[:2]), strict=True)) == want
