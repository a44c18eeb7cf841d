import re
from collections import defaultdict

import numpy as np

from vicinal.llm.minhash import BITS, MINIMA, estimate, linked, minima, op5_minhash, packed, unique

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (n, component), from an inverted index."""
    sets = {i: shingle_set(t) for i, t in rows}
    by, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        seen = defaultdict(int)
        for g in sets[i]:
            for j in by[g]:
                seen[j] += 1
            by[g].append(i)
        for j, both in seen.items():
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_whole_table_as_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    got = op5_minhash(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert any(i != c for i, (_, c) in want.items())


def test_chain_copies_and_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    hub = " ".join(base)
    near = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in (0, 58)]
    rows = [(5, hub), (3, near[0]), (9, near[1]), (4, hub.upper().replace("W", "w")), (7, None), (8, ""), (10, " \n "), (11, "one two"), (12, "One  TWO"), (13, "two one"), (14, "É é"), (15, "é é"), (5, hub), (None, "alone here"), (20, "a " * 30000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = linked(docs.selectExpr("*", "1 as n", "2 as cid", "3 as d1")).collect()
    want = brute([(i, t) for i, t in rows if i is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) and next(r for r in got if r.doc_id is None).kept
    assert sorted(r.doc_id for r in unique(docs).collect() if r.doc_id is not None) == sorted(i for i, t in rows if i is not None and want[i][1] == i)


def test_hub_whose_neighbours_are_not_linked(spark):
    """Each copy is near the hub only; the hub has the largest id, so no leader by id finds it."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):
        c = list(base)
        for p in rng.choice(200, 5, replace=False):
            c[p] = f"y{k}_{p}"
        rows.append((k, " ".join(c)))
    rows.append((99, " ".join(base)))
    got = {r.doc_id: r.component_id for r in linked(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_family_of_near_copies(spark):
    """Hundreds of copies with few or many changes: some are linked, others are near all of them but linked with none."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(700):
        c = list(base)
        for p in rng.choice(120, int(rng.integers(1, 8)), replace=False):
            c[p] = f"y{k}_{p}"
        rows.append((k, " ".join(c)))
    got = {r.doc_id: r.component_id for r in linked(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()}
    want = {i: c for i, (_, c) in brute(rows).items()}
    assert got == want and 1 < len(set(want.values())) < 700


def test_empty_table(spark):
    assert linked(spark.createDataFrame([], DOCS)).count() == 0


def test_estimate_near_truth(spark):
    rng = np.random.default_rng(2)
    common, own = rng.integers(0, 2**63, 600, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    sigs = [packed(minima(np.sort(g), np.array([0, len(g)])))[0].tolist() for g in (common, np.concatenate([common, own]))]
    got = spark.createDataFrame([tuple(sigs)], "a array<long>, b array<long>").select(estimate("a", "b").alias("e")).first().e
    assert abs(got - 0.75) < 0.15 and len(sigs[0]) == BITS * MINIMA // 64


def test_regular_words_aren_t_equal(spark):
    """A word of two letters in the order of Thue and Morse and its complement: sums of powers agree for them, whatever the base."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word, "en", "s", 0), (2, other, "en", "s", 0), (3, " ".join([word] * 5), "en", "s", 0), (4, " ".join([other] * 5), "en", "s", 0), (5, word.upper(), "en", "s", 0), (6, "x" * 200_000, "en", "s", 0), (7, "x" * 200_001, "en", "s", 0)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in linked(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 1), 6: (1, 6), 7: (1, 7)}
