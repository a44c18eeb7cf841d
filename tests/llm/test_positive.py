"""Traits against a plain reading of texts, the fit against the risk itself, and held-out accuracy."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinal.llm import positive as P
from vicinal.llm.flat import text_bytes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(text):
    b = (text or "").encode()
    w = WORD.findall(b)
    low = [x.lower() for x in w]
    lines = [x.lower() for x in b.split(b"\n") if WORD.search(x)]
    three = Counter(zip(low, low[1:], low[2:], strict=False))
    up, down = len(re.findall(rb"[A-Z]", b)), len(re.findall(rb"[a-z]", b))
    per = lambda x, y: x / max(1, y)
    over = lambda x, t: sum(x > y for y in t)
    rates = [per(len(re.findall(rb"[#*$%&|<>]", b)), len(w)), per(up, up + down), per(len(re.findall(rb"[!?]", b)), len(w)), per(sum(x == y for x, y in zip(low, low[1:], strict=False)), len(w)), per(sum(n for n in three.values() if n > 1), len(w)), per(len(w) - len(set(low)), len(w)), per(len(lines) - len(set(lines)), len(lines)), per(len(re.findall(rb"[0-9]", b)), sum(map(len, w))), per(sum(x[-1:] in b".,;:!?" for x in w), len(w))]
    return [over(len(w), P.WORDS), over(per(sum(map(len, w)), len(w)), P.MEAN), over(max(map(len, w), default=0), P.LONGEST), *(over(x, P.RATES) for x in rates)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab A!\n.1$é\t", max_size=60)), max_size=8))
def test_traits(texts):
    assert P.traits(*text_bytes(pa.array(texts, pa.string()))).reshape(-1, P.TRAITS).tolist() == [plain(t) for t in texts]


def test_codes_hold_their_levels():
    levels = np.random.default_rng(1).integers(0, P.LEVELS + 1, (50, P.TRAITS))
    x = P.inputs(P.packed(levels))
    assert (x[:, :-1].reshape(50, P.TRAITS, P.LEVELS).sum(2) == levels).all() and (x[:, -1] == 1).all()


@pytest.fixture(scope="module")
def weights(spark):
    rng = np.random.default_rng(3)
    good = rng.random(3000) < 0.7
    levels = np.zeros((3000, P.TRAITS), int)
    levels[:, 3] = np.where(good, rng.integers(0, 5, 3000), rng.integers(2, 9, 3000))
    levels[:, 0] = rng.integers(0, 9, 3000)
    trusted = good & (rng.random(3000) < 0.5)
    table = Counter(), Counter()
    for c, t in zip(P.packed(levels).tolist(), trusted.tolist(), strict=True):
        table[0][c] += 1
        table[1][c] += t
    rows = [(c, n, table[1][c]) for c, n in table[0].items()]
    return spark.createDataFrame(rows, "code long, u long, p long"), good.mean()


def test_prior_and_the_least_risk(weights):
    df, share = weights
    w, got = P.fit(df)
    assert abs(got - share) < 0.08
    rows = df.toPandas()
    x, u, p = P.inputs(rows.code.to_numpy()), rows.u.to_numpy() / rows.u.sum(), rows.p.to_numpy() / rows.p.sum()

    def objective(w):
        r = P.risks(x @ w, u, p)
        less = r[0] - got * r[1]
        return got * r[2] + less + P.RIDGE / 2 * w @ w if less >= -P.by_chance(rows.u.sum(), rows.p.sum()) else np.inf

    least = objective(w)
    assert least < objective(np.zeros(P.SIZE))
    rng = np.random.default_rng(5)
    assert all(objective(w + d * s) >= least - 1e-5 for d in rng.normal(size=(200, P.SIZE)) for s in (1e-1, 1e-2, 1e-3))
    again, _ = P.fit(df.repartition(5))
    assert np.allclose(w, again, atol=1e-6)


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = P.scored(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    # labels of held-out ids and other columns change nothing
    other = P.scored(spark.read.parquet(f"{d}/documents.parquet").drop("lang", "source"), labels.withColumn("quality", P.F.when(P.held_out(), 1 - P.F.col("quality")).otherwise(P.F.col("quality"))))
    assert {r.doc_id: round(r.score, 9) for r in got.collect()} == {r.doc_id: round(r.score, 9) for r in other.collect()}


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "x y"), (3, "A b. " * 100_000), (3, "A b. " * 100_000), (4, "z" * 300_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as code", "2 as n", "true as held_out")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = P.scored(df, labels).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    labels = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    got = P.scored(df, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 3}) == 1
    assert P.scored(df.limit(0), labels).count() == 0 and P.scored(df, labels.limit(0)).count() == 6
