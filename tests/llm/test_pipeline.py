import json
from collections import Counter

import corpus_pipeline
from tests.llm.test_minhash import brute


def test_stages_on_a_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "secrets", "mixing", "encoding"] and corpus_pipeline.ORACLE_SQL is None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        seen[name] = rows
        if name != "encoding":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
    kept = seen["quality"]
    assert 0.5 * len(before) < len(kept) < len(before) and all(r.n_chars == len(r.text) for r in kept)
    want = brute([(r.doc_id, r.text) for r in kept])
    assert sorted(r.doc_id for r in seen["near_dedup"]) == sorted(i for i, (_, c) in want.items() if i == c)
    assert [r.doc_id for r in sorted(seen["secrets"], key=lambda r: r.doc_id)] == sorted(r.doc_id for r in seen["near_dedup"])
    taken = Counter(r.doc_id for r in seen["mixing"])
    assert max(taken.values()) <= 2 and set(taken) <= {r.doc_id for r in seen["secrets"]}
    assert Counter(r.doc_id for r in seen["encoding"]) == taken
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(seen["mixing"]) / (1.5 * words(seen["secrets"])) - 1) < 0.1
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, seen["encoding"]))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, host string, copies int"


def say(i, n=60):
    name = "".join("abcdefghij"[int(c)] for c in str(i))
    return " ".join(f"w{name}x{k}" for k in range(n))


def chain(spark, rows, sf):
    docs, out = spark.createDataFrame(rows, COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        out[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "host", "copies"], name
            docs = spark.createDataFrame(out[name], COLUMNS)
    return out


def test_odd_rows_through_all_stages(spark, sf):
    long_ = say(7, 120_000)
    rows = [(i, say(i), "en", "abc"[i % 3], None, "clash", i) for i in range(30)]
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "a", 0, None, None), (102, " \n\t", "en", None, 3, None, None), (None, say(200), None, None, None, "h", 1), (103, long_, "en", "a", 1, None, 0)]
    rows += [(40, say(300), "en", "a", 1, None, 0), (41, say(300), "en", "b", 1, None, 0), (41, say(300), "en", "b", 1, None, 0), (50, say(301), "en", "a", 1, None, 0), (50, say(301), "en", "a", 1, None, 0)]
    rows += [(60, say(302, 55) + " token = 'abcdefABCDEF123456'", "en", "a", 1, None, 0)]
    out = chain(spark, rows, sf)
    kept = Counter(r.doc_id for r in out["quality"])
    assert kept == Counter([*range(30), None, 103, 40, 41, 41, 50, 50, 60]) and all(r.n_chars == len(r.text) for r in out["quality"])
    single = Counter(r.doc_id for r in out["near_dedup"])
    assert single == Counter([*range(30), None, 103, 40, 50, 60])
    secret = {r.doc_id: r.text for r in out["secrets"]}
    assert Counter(r.doc_id for r in out["secrets"]) == single and secret[60].endswith(" [secret]'") and secret[103] == long_ and secret[0] == say(0)
    taken = Counter(r.doc_id for r in out["mixing"])
    assert max(n / single[i] for i, n in taken.items()) <= 2
    assert Counter(r.doc_id for r in out["encoding"]) == taken and all(r.n_tokens > 1 for r in out["encoding"])
    again = chain(spark, rows[::-1], sf)
    assert all(sorted(json.dumps(r.asDict()) for r in out[n]) == sorted(json.dumps(r.asDict()) for r in again[n]) for n in out)


def test_empty_table_through_all_stages(spark, sf):
    assert not any(chain(spark, [], sf).values())
