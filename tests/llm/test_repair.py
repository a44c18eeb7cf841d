"""Repairs against all edit sequences, SQL, and cases by hand."""

import hashlib
import itertools
import zlib

import duckdb
import pytest

from vicinal.llm import repair as R
from vicinal.llm.queries import SQL

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """By trying every sequence of edits: rows are (initial, forced, truncated)."""
    best = None
    for edits in itertools.product("DKRr", repeat=len(rows)):
        if any(f and e != "D" for e, (_, f, _) in zip(edits, rows, strict=True)):
            continue
        for inserts in itertools.product(("", "I", "II", "III"), repeat=len(rows) + 1):
            roles, cost, audit = [], 0, ""
            for k, gap in enumerate(inserts):
                roles += ["?"] * len(gap)
                cost += 2 * len(gap)
                audit += gap
                if k == len(rows):
                    break
                e, (initial, _, cut) = edits[k], rows[k]
                audit += e.upper()
                cost += {"D": 3, "K": 0}.get(e, 2) + (cut if e != "D" else 0)
                if e != "D":
                    roles.append({"K": initial, "R": "u", "r": "a"}[e])
            want = (["s"] if len(roles) % 2 else []) + ["u", "a"] * (len(roles) // 2)
            if len(roles) != 1 and all(r in ("?", w) and not (r == "?" and w == "s") for r, w in zip(roles, want, strict=True)):
                best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("initials", ["".join(x) for n in range(4) for x in itertools.product("suax", repeat=n)])
def test_chart_is_the_cheapest_of_all_edits(initials):
    for marks in {"k" * len(initials), ("tkd" * 2)[: len(initials)], ("bkt" * 2)[: len(initials)]}:
        ends = R.chart([(i, m, 1) for i, m in zip(initials, marks, strict=True)])
        got = min((c + R.closing(s)[0], a + R.closing(s)[1]) for s, (c, a) in ends.items())
        assert got == cheapest([(i, m in "bd", m == "t") for i, m in zip(initials, marks, strict=True)])


def sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    cur = con.execute(SQL["op11_repair"])
    names = [d[0] for d in cur.description]
    return sorted((tuple(dict(zip(names, r, strict=True))[c] for c in COLUMNS) for r in cur.fetchall()), key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_odd_rows(spark):
    data = [(1, t, "user" if t % 2 else "assistant", f"No {t}.") for t in range(1, 9)]
    data += [(2, None, "system", "Be kind."), (2, 3, None, None), (2, 3, "user", ""), (2, 9, "user", "Well\n"), (2, 9, "user", "Well\n"), (2, 9, "user", "Well\n")]
    data += [(None, 1, "user", "Hi!"), (None, None, "assistant", "Hello."), (3, 4, "assistant", "x" * 200_000), (4, None, "sage", "A."), (4, None, "sage", "A.")]
    assert rows(R.repair(spark.createDataFrame(data, SCHEMA))) == sql(data)


def test_conversations_longer_than_a_chunk(spark):
    pick = lambda *x: zlib.crc32(repr(x).encode())
    data = [(c, t if pick(c, t, 1) % 50 else None, ["user", "assistant", "system", "tool"][pick(c, t) % 13 // 5], ["Yes.", "No", "", f"Turn {t}!"][pick(c, t, 2) % 4]) for c in range(3) for t in range(300)]
    want = sql(data)
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(R.repair(df, chunk=8)) == want
    assert rows(R.repair(df.repartition(5))) == want


def test_lost_and_empty(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    got = rows(R.repair(spark.createDataFrame([(lost, 1, "user", "Hi.")], SCHEMA)))
    assert got == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert R.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns_and_one_row_many_times(spark):
    data = [(5, 2, "user", "Same.")] * 700 + [(5, 3, "assistant", "Other.")]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as n", "2 as pos", "'x' as audit", "'y' as _conv")
    assert rows(R.repair(df)) == sql(data)
