"""Alignments against a plain reading of every text: both libraries on whole texts, all pairs of tokens compared."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vicinal.llm import alignment as A

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def letters():
    """Byte-level letters back to bytes: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def tokens(text, libraries):
    t, sp = libraries
    if not text:
        return [], []
    back = letters()
    e = t.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in e.ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    want = f" {text}".encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def spans(toks):
    out, at = [], 0
    for i, x in toks:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(docs, libraries):
    read = [tuple(map(spans, tokens(text, libraries))) for _, text in docs]
    links = [[(i, j) for i, s, e in a for j, u, v in b if s < v and u < e] for a, b in read]
    counts = Counter(p for x in links for p in set(x))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for (doc_id, _), (a, b), pairs in zip(docs, read, links, strict=True):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        said = ";".join("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)) for lo, hi in zip([0, *ends], ends, strict=False))
        out.append((doc_id, len(a), len(b), len(ends), len(pairs), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


ODD = ["", None, " ", "  ", "\n", "a", " a", "a ", "  a  b \n c\t\td ", "It's we'll 12 345 x1y", "▁", "a▁ b c", "<|endoftext|> </s> <s> <0x41>", "naïve Ærøskøbing 日本語 テスト", "👩‍👩‍👧 ok", "\x00\x01 z", "a b  c", "x  y 　z", "same words here", "same words here", "é ́ a", "\x85 a \x1c b", "᠎a b​ c", "!!! ... $$$ a$ b", "\r\n\r\n a \r b", "a  \n  b", "ﬁ ½ Ⅷ ①"]


def test_odd_texts(spark, libraries):
    docs = list(enumerate(ODD[:-1])) + [(None, ODD[-1]), (3, "same words here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_a", "2 as row", "'x' as pairs")
    assert rows(A.alignment(df)) == plain(docs, libraries)


def test_whole_table(spark, sf, libraries):
    df = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 4000")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    want = plain(docs, libraries)
    assert rows(A.alignment(df)) == want
    assert rows(A.alignment(df.repartition(3), broadcast=0)) == want


def test_very_long_segments(libraries):
    sides = A.Sides(*A.files())
    t, sp = libraries
    for text in ("ab" * 60_000, " " * 100_000 + "x", "\n" * 50_000, "é" * 40_000, "word " * 50_000):
        n_a, n_b, groups, links, sha, pairs, times = next(sides.align([text]))
        assert (n_a, n_b) == (len(t.encode(" " + text, add_special_tokens=False).ids), len(sp.encode(text)))
        assert links == times.sum() and groups <= min(n_a, n_b)


def test_empty_table(spark):
    assert A.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
