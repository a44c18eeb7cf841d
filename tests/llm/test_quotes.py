import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from vicinal.llm.quotes import linked, normal, op9_quotes, ordered, passages, quoting, units

MSG = "conv_id long, turn long, role string, text string, level int"


def brute(rows):
    """{(conv, turn): (parent, root, depth, place)} by plain loops over all earlier messages."""
    said = {}
    for c, t, text in rows:
        runs = passages(text) if text else []
        own = [ps for level, ps in runs if level == 0]
        whole = normal(" ".join(p for ps in own for p in ps))
        said[c, t] = (whole, {u for ps in own for _, u in units(ps) if len(u.split()) >= 3} | {whole})
    parent = {}
    for c, t, text in rows:
        best = {}
        for i, (level, ps) in enumerate(passages(text) if text else []):
            if not level:
                continue
            for kind in (0, 1, 2):
                score = defaultdict(int)
                for u in {u for k, u in units(ps) if k == kind and u}:
                    if len(u.split()) < 3 and kind:
                        continue
                    short = len(u.split()) < 3
                    at = [s for (d, s), (w, us) in said.items() if d == c and s < t and (u == w if short else u in us)]
                    if at:
                        score[max(at)] += len(u.split())
                if score:
                    best[i] = (level, max((n, s) for s, n in score.items()))
                    break
        if best:
            least = min(level for level, _ in best.values())
            total = defaultdict(int)
            for level, (n, s) in best.values():
                if level == least:
                    total[s] += n
            parent[c, t] = max((n, s) for s, n in total.items())[1]
    out, child = {}, defaultdict(list)
    for (c, t), p in sorted(parent.items(), key=(lambda x: (str(x[0][0]), x[0][1]))):
        child[c, p].append(t)

    def walk(c, t, root, depth, place):
        out[c, t] = (parent.get((c, t)), root, depth, place)
        n = 1
        for x in child[c, t]:
            n += walk(c, x, root, depth + 1, place + n)
        return n

    for c, t, _ in rows:
        if (c, t) not in parent:
            walk(c, t, t, 0, 0)
    return out


def got(df):
    return {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.place) for r in df.collect()}


def test_nested_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort a list? It is long.\nVery long.", 0),
        (1, 1, "assistant", "Use sorted for that.\nSee the docs as well.", 0),
        (1, 2, "user", "On Monday A wrote:\n> how do i  sort\n> a list\n\nMe too!", 0),
        (1, 3, "user", "> > How do I sort a list?\n> Use sorted for that. See\n> the docs as well\nThat has worked", 0),
        (1, 4, "assistant", ">>> nobody said this\nok", 0),
        (1, 5, "user", "> That has worked\nWhich?", 0),
        (1, 6, "user", "> ok\nfine", 0),
        (1, 7, "user", "well, ok\n> Which\nno", 0),
        (1, 8, "user", "> ok\nlate", 0),
        (2, 0, "user", "> Use sorted for that.\nother conversation", 0),
        (2, 1, "user", None, 0),
        (2, 2, "user", "", 0),
        (2, 3, None, ">\n> \n", 0),
        (None, 0, "user", "x", 0),
        (None, 1, "user", "> x", 0),
        (-1, 1, "user", "> x", 0),
        (3, 0, "user", "a\n> a", 0),
        (3, None, "user", "> a", 0),
    ]
    df = spark.createDataFrame(rows, MSG)
    rows_ = {(r.conv_id, r.turn): r for r in ordered(df).collect()}
    assert len(rows_) == len(rows)
    assert {k: v.parent_turn for k, v in rows_.items() if v.parent_turn is not None} == {(1, 2): 0, (1, 3): 1, (1, 5): 3, (1, 6): 4, (1, 7): 5, (1, 8): 4, (None, 1): 0}
    assert rows_[1, 2].text == "Me too!" and rows_[1, 3].text == "That has worked" and rows_[1, 4].text == "ok" and rows_[2, 1].text is None
    assert (rows_[1, 5].root_turn, rows_[1, 5].depth, rows_[1, 5].place, rows_[1, 5].n_quoted, rows_[1, 5].n_linked) == (1, 2, 2, 1, 1)
    want = brute([(c, t, x) for c, t, _, x, _ in rows if t is not None])
    assert {k: v for k, v in got(ordered(df)).items() if k[1] is not None} == want
    twice = ordered(df.union(df).withColumn("place", df.level))
    assert twice.count() == 2 * len(rows) and got(twice) == got(ordered(df))
    texts = df.selectExpr("concat('c', conv_id) AS conv_id", "cast(turn AS string) AS turn", "role", "text")
    assert {(r.conv_id, r.turn): r.parent_turn for r in ordered(texts).collect()}["c1", "3"] == 1
    assert linked(df.withColumn("turn", df.role)).count() == 0


def test_long_chain_and_wide_thread(spark):
    rows = [(7, i, "user", f"> message number {i - 1} is this\nmessage number {i} is this", 0) for i in range(300)]
    rows += [(8, i, "user", "the first of all\n" if not i else f"> the first of all\nanswer number {i} here\n" + (f"> answer number {i - 7} here" if i % 3 == 0 else ""), 0) for i in range(2000)]
    df = spark.createDataFrame(rows, MSG)
    found = got(ordered(df))
    assert all(found[7, i] == (i - 1 if i else None, 0, i, i) for i in range(300))
    assert found == brute([(c, t, x) for c, t, _, x, _ in rows if c == 8]) | {(7, i): found[7, i] for i in range(300)}
    assert sorted(v[3] for (c, _), v in found.items() if c == 8) == list(range(2000))


def test_very_long_message(spark):
    long_ = " ".join(f"word{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, 0, "user", long_, 0), (1, 1, "user", "> " + re.sub(r"((\S+ ){9}\S+) ", "\\1\n> ", long_), 0)], MSG)
    assert got(ordered(df))[1, 1] == (0, 0, 1, 1)


def test_whole_table_as_brute_force_and_empty(spark, sf):
    df = quoting(spark.read.parquet(f"{sf}/conversations.parquet"))
    rows = [(r.conv_id, r.turn, r.text) for r in df.collect()]
    found = got(op9_quotes(spark, sf))
    want = brute(rows)
    assert found == want and sum(v[0] is not None for v in found.values()) > 0.2 * len(rows)
    plain = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert all(r.text == plain[r.conv_id, r.turn].strip() for r in ordered(df).collect())
    assert ordered(spark.createDataFrame([], MSG)).count() == 0


def test_long_lines_take_time_by_their_length(spark):
    """Lines, marks, blanks and unbroken texts of up to a million characters: no pattern may look at them again and again."""
    n = 1_000_000
    odd = [">" * 100_000, "> " * 100_000 + "hm", "x" * n, "x" * (n // 2) + "." * (n // 2) + "x", "a" + "*" * n + "b", "wrote" + " " * n + "x", "a" + " " * n + "b", "a b " * (n // 4), ":" * n, "\n" * n, "?! " * (n // 3), "x" * n + ". y"]
    rows = [(i, t, "user", x) for i, x in enumerate(odd) for t in (0, 1, 2, 3)] + [(99, 0, "user", "Plain words stand here."), (99, 1, "user", "> Plain words stand here.\nYes")]
    began = time.time()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = ordered(df).select("conv_id", "turn", "n_quoted", "n_linked", F.length("text").alias("n")).collect()
    assert len(got) == len(rows) and {r.n_quoted for r in got if r.conv_id == 0} == {1}
    assert [r.n_linked for r in got if (r.conv_id, r.turn) == (99, 1)] == [1]
    assert quoting(df).select(F.sum(F.length("text"))).first()[0] > sum(len(x[3]) for x in rows)
    assert time.time() - began < 120


def test_new_patterns_match_as_the_old_ones(spark):
    """The forms that go back over a text, on short texts."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab .!?\n\t  ") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    old = df.select(F.regexp_replace("t", r"((?:\S+[ \t]+){7}\S+)[ \t]+", "$1\n").alias("w"), F.regexp_extract("t", r"([^.!?]+[.!?]+\s*)$", 1).alias("s")).collect()
    new = df.select(F.regexp_replace("t", r"(?<!\S)((?:\S++[ \t]++){7}\S++)[ \t]++", "$1\n").alias("w"), F.regexp_extract("t", r"(?<![^.!?])([^.!?]++[.!?]++\s*+)$", 1).alias("s")).collect()
    assert old == new
