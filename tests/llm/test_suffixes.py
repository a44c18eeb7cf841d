import hashlib
from collections import Counter

import numpy as np

from vicinal.llm import suffixes
from vicinal.llm.suffixes import measured, op3_suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long"


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(rows, ids, texts):
    want = dict(zip(ids, brute(texts), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == want


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = op3_suffixes(spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_removed > 0 for r in got) > 5
    check(got, [r.doc_id for r in docs], [r.text for r in docs])


def test_planted(spark, monkeypatch):
    rng = np.random.default_rng(9)
    word = lambda n: " ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(n))
    passage = word(50)
    exact = "".join(rng.choice(list("xyz"), 200))
    texts = [word(80) + passage[:240] + word(10) for _ in range(30)]
    texts += [word(40) + passage for _ in range(10)] + [texts[0], texts[0]]
    texts += [exact, "q" + exact + "r", exact[:199] + "s", exact[1:] + "t"]
    texts += ["ab" * 400, "z" * 199, "z" * 200, "y" * 201, None, "", "\0" * 300, word(3) * 90]
    docs = spark.createDataFrame([(i, t, None, None, None, 7) for i, t in enumerate(texts)], DOCS)
    check(measured(docs).collect(), range(len(texts)), texts)
    # the same with anchors dealt to many shards
    monkeypatch.setattr(suffixes, "PIECE", 3)
    monkeypatch.setattr(suffixes, "SHARD", 3000)
    check(measured(docs).collect(), range(len(texts)), texts)
    assert measured(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "w" * 150 + "v" * 150, None, None, None, 7)] * 2, DOCS)
    assert [r.n_removed for r in measured(same).collect()] == [300, 300]


def test_regular_contexts_aren_t_equal(spark):
    """Texts of two letters in the order of Thue and Morse share long strings, and sums of powers agree for those that differ."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word[:1024], other[:1024], word[100:700], "x" * 300 + word[:256], "y" * 300 + other[:256]]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 0) for i, t in enumerate(texts)], DOCS)
    check(measured(df).collect(), range(len(texts)), texts)
