import duckdb

from vicinal.llm.revisits import OP1_SQL, canonical, op1_revisits, resolve, with_bodies

H = "array<struct<k:string,v:string>>"
REC = f"record_id long, kind string, url string, at long, headers {H}, digest string, extra int"


def h(**kv):
    return [(k.replace("_", "-"), v) for k, v in sorted(kv.items())]


def brute(spark, rows):
    url = {r.record_id: r.c for r in spark.createDataFrame(rows, REC).select("record_id", canonical("url").alias("c")).collect()}
    out = {}
    for i, kind, _, at, head, digest, _ in rows:
        if kind != "revisit":
            continue
        full = [x for x in rows if x[1] == "response" and x[3] is not None and at is not None and x[3] < at and url[x[0]] is not None and url[x[0]] == url[i]]
        if not full:
            out[i] = ("missing", None)
            continue
        best = max(full, key=lambda x: (x[3], x[0]))
        a, b = dict(head or []), dict(best[4] or [])
        strip = lambda t: t[2:] if t[:2] in ("W/", "w/") else t
        if "etag" in a and "etag" in b:
            same = strip(a["etag"]) == strip(b["etag"])
        elif "last-modified" in a and "last-modified" in b:
            same = a["last-modified"] == b["last-modified"]
        else:
            same = True if digest is not None and digest == best[5] else None
        out[i] = ("unchecked", None) if same is None else ("resolved", best[0]) if same else ("changed", None)
    return out


def test_as_brute_force(spark):
    rows = [
        (1, "response", "http://A.example:80/x/", 10, h(etag='"a"', content_type="text/html", date="d1", expires="e1"), "s1", 0),
        (2, "revisit", "https://a.example/x#top", 20, h(etag='W/"a"', content_type="no", date="d2"), None, 0),
        (3, "response", "https://a.example/x?utm_source=f", 30, h(etag='"b"', last_modified="m"), "s2", 0),
        (4, "revisit", "https://a.example/x", 40, h(etag='"a"'), None, 0),
        (5, "revisit", "https://a.example/x", 5, h(etag='"a"'), None, 0),
        (6, "revisit", "https://a.example/x", 31, h(last_modified="m"), None, 0),
        (7, "revisit", "https://a.example/x", 30, h(etag='"a"'), None, 0),
        (8, "revisit", None, 50, None, None, 0),
        (9, "revisit", "https://a.example/x", None, h(etag='"b"'), None, 0),
        (10, "revisit", "https://a.example/x", 50, None, "s2", 0),
        (11, "revisit", "https://a.example/x", 50, None, "other", 0),
        (12, "response", "https://a.example/y?b=2&a=1", 1, None, "y", 0),
        (13, "response", "https://a.example/y?a=1&b=2", 1, None, "z", 0),
        (14, "revisit", "https://a.example/y?a=1&b=2", 2, None, "z", 0),
        (15, "response", "nonsense", 1, h(etag="q"), "n", 0),
        (16, "revisit", "nonsense", 9, h(etag="q"), "n", 0),
    ] + [(100 + i, "response" if i % 3 else "revisit", "http://hot.example/", i, h(etag=str(i // 4)), None, 0) for i in range(3000)]
    got = {r.record_id: r for r in resolve(spark.createDataFrame(rows, REC)).collect()}
    assert {i: (r.state, r.source_id) for i, r in got.items()} == brute(spark, rows)
    assert [tuple(x) for x in got[2].headers] == h(etag='W/"a"', content_type="text/html", date="d2", expires="e1") and got[2].digest == "s1"
    bodies = spark.createDataFrame([(1, "<p>")], "record_id long, body string")
    assert {r.record_id: r.body for r in with_bodies(resolve(spark.createDataFrame(rows[:5], REC)), bodies).collect()} == {2: "<p>", 4: None, 5: None}
    assert resolve(spark.createDataFrame([], REC)).count() == 0


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = op1_revisits(spark, sf).collect()
    got = [tuple(r) for r in rows]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(got, key=str) == sorted(con.execute(OP1_SQL).fetchall(), key=str) and len(got) == 520
    states = {s: sum(r.state == s for r in rows) for s in ("resolved", "changed", "unchecked", "missing")}
    assert min(states.values()) >= 20 and len({r.source_id % 5 for r in rows if r.state == "resolved"}) == 2


def test_repeated_rows_outliers_and_extra_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, "response" if i % 2 else "revisit", "http://hot.example/", i // 4, h(etag=str(i // 8)), None, 0) for i in range(4000)]
    rows += [(9000, "response", "http://cold.example/", 10**15, None, None, 0), (9001, "revisit", "http://hot.example/", 10**15 + 1, h(etag="499"), None, 0), (9002, "metadata", "http://hot.example/", 5, None, None, 0)]
    df = spark.createDataFrame(rows, REC)
    got = {r.record_id: (r.state, r.source_id) for r in resolve(df).collect()}
    assert got == brute(spark, rows) and 9002 not in got
    twice = resolve(df.union(df).withColumns({"found": F.lit(1), "state": F.lit("x"), "_stretch": F.lit(2)}))
    assert twice.count() == 2 * len(got) and {r.record_id: (r.state, r.source_id) for r in twice.collect()} == got
