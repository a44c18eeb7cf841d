import numpy as np
import pytest

from vicinal.llm import flatgraph
from vicinal.llm.flatgraph import linked, op4_vectors, scaled


def brute(ids, vecs):
    ok = [i for i, v in enumerate(vecs) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, comp = {i: 0 for i in range(len(ids))}, list(range(len(ids)))
    x = np.array([vecs[i] for i in ok], np.float64)
    norm = np.sqrt((x * x).sum(1))
    c = (x @ x.T) / norm[:, None] / norm[None]

    def root(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i in range(len(ok)):
        near = np.flatnonzero(c[i] >= 0.95)
        n[ok[i]] = len(near) - 1
        for j in near:
            a, b = root(ok[i]), root(ok[j])
            if a != b:
                if ids[a] > ids[b]:
                    a, b = b, a
                comp[b] = a
    return {ids[i]: (n[i], ids[root(i)]) for i in range(len(ids))}


def test_whole_table_as_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = op4_vectors(spark, sf).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_dense_groups_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    vecs = [(b + rng.normal(size=16) * s).tolist() for b in base for s in (0.02, 0.05, 0.1, 0.2) for _ in range(12)]
    vecs += [vecs[0]] * 40 + [[2 * v for v in vecs[5]]] + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [0.0] * 15]
    ids = rng.permutation(len(vecs)).tolist()
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in zip(ids, vecs, strict=True)], "vec_id long, embedding array<double>, label int, size int")
    got = linked(df).collect()
    want = brute(ids, vecs)
    assert {r.vec_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}
    assert sum(r.n_links for r in got) >= 0.99 * sum(n for n, _ in want.values()) and all(r.n_links <= want[r.vec_id][0] for r in got)
    assert linked(df.limit(0)).count() == 0


VEC = "vec_id long, embedding array<double>"


def test_links_count_for_both_ends(spark, monkeypatch):
    """Pairs over the borders of many shards: who has a link counts it, and who has none is alone."""
    monkeypatch.setattr(flatgraph, "SHARD", 100)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1500, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = base + rng.normal(size=base.shape) * 0.28 / np.sqrt(24)
    lone = rng.normal(size=(300, 24))
    vecs = np.concatenate([base, other, lone]).tolist()
    got = linked(spark.createDataFrame(list(enumerate(vecs)), VEC)).collect()
    want = brute(list(range(len(vecs))), vecs)
    comp = {}
    for r in got:
        comp.setdefault(r.component_id, []).append(r)
    assert all((r.n_links == 0) == (len(rows) == 1) for rows in comp.values() for r in rows)
    assert all(rows[0].n_links == rows[1].n_links for rows in comp.values() if len(rows) == 2)
    assert sum(r.n_links for r in got) >= 0.99 * sum(n for n, _ in want.values()) > 1000


def test_every_length_is_linked(spark):
    rng = np.random.default_rng(8)
    vecs = [(rng.normal(size=2)).tolist() for _ in range(20)] + [(np.array([1.0, 2, 3]) + rng.normal(size=3) * 0.01).tolist() for _ in range(5)]
    vecs += [[1.0, 2.0, 3.0, 0.0], [1.0, 2.0, 3.0, 0.001]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in linked(spark.createDataFrame(list(enumerate(vecs)), VEC)).collect()}
    assert all(got[i] == (4, 20) for i in range(20, 25)) and got[25] == (1, 25) and got[26] == (1, 25)
    pairs = [(i, j) for i in range(20) for j in range(20) if i != j and np.dot(vecs[i], vecs[j]) / np.linalg.norm(vecs[i]) / np.linalg.norm(vecs[j]) >= 0.95]
    assert all(got[i][0] == sum(a == i for a, _ in pairs) for i in range(20))


def test_large_and_small_numbers(spark):
    base = [[1e200, 2e200], [1e200, 2.1e200], [1e-200, 2e-200], [3.0, 6.0], [5e-324, 1e-323], [1e308, -1e308]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in linked(spark.createDataFrame(list(enumerate(base)), VEC)).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 5: (0, 5)}
    x = np.random.default_rng(1).normal(size=(50, 7))
    assert (scaled(x) * 2.0 ** (np.log2(np.abs(x).max(1) / np.abs(scaled(x)).max(1)).round())[:, None] == x).all()


def test_repeated_and_null_ids(spark):
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.01]), (4, [0.0, 1.0]), (None, [-1.0, 0.0]), (0, [-0.0, 2.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in linked(spark.createDataFrame(rows, VEC)).collect()), key=str)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (4, 1, 0, False), (None, 0, None, True), (0, 1, 0, True)], key=str)


@pytest.mark.parametrize("spoil", ["adjacency", "nothing"])
def test_spoilt_graph_takes_the_exact_way(spark, monkeypatch, spoil):
    """Without edges a search sees its medoids only; the audit notices, and all pairs are compared."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    vecs = [(b + rng.normal(size=8) * 0.1).tolist() for b in base for _ in range(60)]
    asked = []
    plain = flatgraph.exact
    monkeypatch.setattr(flatgraph, "exact", lambda c, a=None: asked.append(a) or plain(c, a))
    monkeypatch.setattr(flatgraph, "BLOCK", 500)
    monkeypatch.setattr(flatgraph, "PART", 300)
    if spoil == "adjacency":
        monkeypatch.setattr(flatgraph, "_adjacent", lambda members: members.select(["cid"]).append_column("near", flatgraph.pa.array([[]] * len(members), flatgraph.pa.list_(flatgraph.pa.int64()))))
    got = linked(spark.createDataFrame(list(enumerate(vecs)), VEC)).collect()
    want = brute(list(range(len(vecs))), vecs)
    assert (None in asked) == (spoil == "adjacency")
    n = sum(r.n_links for r in got) / sum(n for n, _ in want.values())
    assert (n == 1 if spoil == "adjacency" else n >= 0.99) and {r.recall for r in got} <= ({1.0} if spoil == "adjacency" else {r for r in [got[0].recall] if r >= 0.99})
