import re
from collections import Counter, defaultdict

from vicinal.llm.quality import MAX_DOCS, MIN_DOCS, MIN_LEFT, MIN_SHARE, clean, judge, op2_quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, line string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub(r"\d", "0", line.lower())).strip(" ")


def brute(rows, min_docs=MIN_DOCS, min_share=MIN_SHARE, min_left=MIN_LEFT, max_docs=MAX_DOCS):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each (id, text, source); documents of
    equal text count once."""
    base, lines, of, total = [], [], defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        text = text or ""
        w = WORD.findall(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        solid = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        base.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(solid) - len(set(solid)), len(hit), failed))
        mine = [(norm(x), len(WORD.findall(x))) for x in solid]
        lines.append((source, mine))
        total[source].add(text)
        for x, _ in mine:
            of[source, x].add(text)
    out = []
    for b, (source, mine) in zip(base, lines, strict=True):
        many = lambda n: n > min_docs and (n > min_share * len(total[source]) or n > max_docs)  # noqa: B023, E731
        gone = sum(k for x, k in mine if many(len(of[source, x])))
        out.append((*b, not b[5] and b[0] - gone >= min_left * b[0] and b[0] > gone))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in df.collect()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op2_quality(spark, sf)) == dict(zip([r[0] for r in rows], brute(rows), strict=True))


def test_lines_and_odd_rows(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i)) if isinstance(i, int) else i
    say = lambda i, n: " ".join(f"w{name(i)}x{name(k)}" for k in range(n))
    rows = [(i, f"Page {i} of  MANY, share it with all\n{say(i, 60)}", "h") for i in range(40)]
    rows += [(100 + i, f"page {i} of many, share it with all\n" * 8 + say(i, 52), "h") for i in range(3)]
    rows += [(200 + i, f"{say('c', 70)}\nanother line of it", "h") for i in range(30)]  # copies of one document
    rows += [(300, None, "h"), (301, "", None), (302, "one two", None), (303, "a b c a b c " * 20, "g"), (304, "\t\n \r\n", "g"), (305, say(5, 60) + " é", None), (306, "x " * 5000, "g"), (307, "page 1 of many, share it with all", "h")]
    rows += [(400 + i, f"boiler plate line\nsecond boiler line here\n{say(i, 30)} " + "tail " * 1 + say(i + 1000, 30), "b") for i in range(30)]
    df = spark.createDataFrame([(i, t, None, s, None, "clash") for i, t, s in rows], DOCS)
    want = dict(zip([r[0] for r in rows], brute(rows), strict=True))
    verdicts, _ = judge(df)
    assert got(verdicts) == want
    assert want[200][6] and not want[300][6] and not want[307][6] and want[0][6] and not want[100][6]
    kept = {r.doc_id: r for r in clean(df).collect()}
    assert set(kept) == {i for i, w in want.items() if w[6]} and kept[20].text == say(20, 60) and kept[20].n_chars == len(kept[20].text) and kept[20].line == "clash"
    assert kept[200].text == rows[43][1] and kept[400].text.startswith("waxa")
    assert clean(df.limit(0)).count() == 0 and judge(df.limit(0))[0].count() == 0
    same = spark.createDataFrame([(1, say(1, 60), None, "h", None, None)] * 3, DOCS)
    assert len(clean(same).collect()) == 3


def test_documents_are_counted(spark):
    """Plain counts of different texts: a long shared passage holds the least windows of most documents, yet each counts."""
    say = lambda i, n: " ".join(f"v{i}y{k}" for k in range(n))
    passage = "\n".join(say(f"p{j}q", 30) for j in range(10))
    rows = [(i, f"{passage}\n{say(i, 20)}", "h") for i in range(14)] + [(20 + i, f"{passage}\n{say(0, 20)}", "h") for i in range(5)]
    rows += [(50 + i, f"{passage}\n{say(i, 20)}", "g") for i in range(10)] + [(70 + i, say(i, 60), "g") for i in range(5)]
    of, total = defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        total[source].add(text)
        for x in text.split("\n"):
            of[source, norm(x)].add(text)
    want = {i: sum(len(WORD.findall(x)) for x in text.split("\n") if len(of[source, norm(x)]) > max(MIN_DOCS, MIN_SHARE * len(total[source]))) for i, text, source in rows}
    verdicts, _ = judge(spark.createDataFrame([(i, t, None, s, None, None) for i, t, s in rows], DOCS))
    got = {r.doc_id: (r.n_frequent_words, r.kept) for r in verdicts.collect()}
    assert got == {i: (n, n == 0) for i, n in want.items()} and want[0] == 300 and want[50] == 0


def test_footer_of_a_large_host(spark):
    """A line in 101 documents goes on a host of 24,000, where it is under the share; one in 100 stays."""
    own = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    say = lambda i: " ".join(f"u{own(i)}z{k}" for k in range(55))
    foot = lambda i: "\nread by permission" * (i < 101) + "\nsent from a train" * (i < 100)
    verdicts, often = judge(spark.createDataFrame([(i, say(i) + foot(i), None, "h", None, None) for i in range(24000)], DOCS))
    assert often.count() == 1
    assert verdicts.filter("n_frequent_lines = 1 and n_frequent_words = 3 and kept and doc_id < 101").count() == 101


def test_one_text_under_two_hosts(spark):
    """Thirty frequent words of a hundred: each host's row counts its own."""
    own = lambda i, n: " ".join(f"q{i}r{k}" for k in range(n))
    boiler = own("b", 30)
    rows = [(1, f"{boiler}\n{own(1, 70)}", h) for h in ("a", "b", None, "-", "\0")]
    rows += [(100 + i, f"{boiler}\n{own(100 + i, 70)}", h) for i in range(12) for h in ("a", "b")]
    df = spark.createDataFrame([(i, t, None, s, None, None) for i, t, s in rows], DOCS)
    verdicts, _ = judge(df)
    found = sorted((r.host, r.n_frequent_words, r.kept) for r in verdicts.filter("doc_id = 1").collect())
    assert found == [("+\0", 0, True), ("+-", 0, True), ("+a", 30, True), ("+b", 30, True), ("-", 0, True)]
    assert [r.text for r in clean(df).filter("doc_id = 1 and source is null").collect()] == [rows[0][1]]
    assert {r.text for r in clean(df).filter("doc_id = 1 and source in ('a', 'b')").collect()} == {own(1, 70)}
