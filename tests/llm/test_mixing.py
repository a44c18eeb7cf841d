from collections import Counter, defaultdict

import duckdb

from vicinal.llm.mixing import mix, op6_mixing, sampled
from vicinal.llm.queries import SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int"


def targets(size, weights=(3, 1, 2)):
    """By rounds: what a capped source can't take is shared among the others."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(size.values())
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(2 * size[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            return {s: 2 * size[s] if s in capped else share[s] for s in order}
        capped |= over


def check(rows, got):
    size = defaultdict(int)
    for _, text, s in rows:
        size[s] += len((text or "").split())
    want, source = targets(size), {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s]) and r.taken <= 2 * r.size
        assert not r.size or r.taken % r.size == 0
        taken[s] += r.taken
    return taken, want


def test_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op6_mixing(spark, sf).collect()
    assert len(got) == len(rows)
    taken, want = check(rows, got)
    assert all(abs(taken[s] / want[s] - 1) < 0.02 for s in want)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL["op6_mixing"]).fetchall())


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 50), s) for i, s in enumerate(["a", "é", None, "B", "z", "zz"] * 100)] + [(1000, None, "a"), (1001, "", "none"), (1002, "x " * 20000, "big"), (1003, "y", "big")]
    df = spark.createDataFrame([(i, t, None, s, None, 5) for i, t, s in rows], DOCS)
    out = lambda d: d.selectExpr("row.doc_id as doc_id", "size", "source_size", "target", "size * copies as taken")
    got = out(sampled(df, ["doc_id"])).collect()
    assert len(got) == len(rows)
    check(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, out(sampled(df.repartition(7), ["doc_id"])).collect()))
    mixed = mix(df)
    assert mixed.columns == df.columns
    n = Counter(r.doc_id for r in mixed.collect())
    assert all(n[r.doc_id] * r.size == r.taken for r in got)
    same = sampled(spark.createDataFrame([(1, "a b", None, "s", None, 1)] * 10, DOCS), ["doc_id"]).collect()
    assert len(same) == 10 and sum(r.copies for r in same) in (14, 15, 16)
    assert sampled(df.limit(0), ["doc_id"]).count() == 0
    assert {r.copies for r in sampled(spark.createDataFrame([(1, "", None, "s", None, 1)], DOCS), ["doc_id"]).collect()} == {0}
