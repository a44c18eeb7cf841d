import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinal.llm.pieces import KEEP, loaded, model_file, op7_sentencepiece, tokenized

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PIECES = loaded(model_file())


def agree(texts):
    for t, (n, ids, decoded) in zip(texts, PIECES.encoded(texts), strict=True):
        want = SP.encode(t, add_eos=True)
        assert ids == " ".join(map(str, want)) and n == len(want), t
        assert decoded.decode() == SP.decode(want) == PIECES.decode(want), t


ODD = ["", " ", "  ", "\n", " \n ", "a", " a", "a ", "▁", "▁▁a", "a▁b", "\t\ttab", "x\r\ny", "aaaaaaaaaaaa", "the the  the   the", "日本語のテキスト", "🙂🙃 emoji", "<s> </s> <unk> <0x0A>", "é", " nbsp", "\x00nul", "ß" * 50, "ab" * (KEEP + 7), " " * (KEEP + 50), "the" * KEEP, "日" * KEEP * 2]


def test_odd_texts():
    agree(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("abtheing  \n▁éñ", max_size=80)), min_size=1, max_size=5))
def test_any_text(texts):
    agree(texts)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text("ab", min_size=200, max_size=2000), st.text("theinrsao", min_size=200, max_size=2000), st.text("tTheE0159-_=/.é日", min_size=200, max_size=2000), st.lists(st.sampled_from(["the", "ing", "tion", "aaaa", "a", "ha", "==", "//", "xx", "日本"]), min_size=100, max_size=600).map("".join), st.tuples(st.text("abeht", min_size=1, max_size=7), st.integers(100, 900)).map(lambda x: x[0] * x[1])))
def test_long_segments(text):
    """Texts without a space are one segment of many blocks."""
    agree([text, text + " " + text[:50]])


def test_very_long_segments():
    """Rounds don't grow with the length."""
    import random

    rng = random.Random(4)
    words = SP.decode(list(range(3000, 5000))).replace(" ", "")
    texts = ["a" * 300_000, "ab" * 100_000, "".join(rng.choice("etaoinshr") for _ in range(200_000)), words * 10, "".join(rng.choice("0123456789abcdef") for _ in range(200_000))]
    agree(texts)
    assert all(len(s) <= KEEP for s in PIECES.cache)


@pytest.mark.parametrize("ids", [[2], [300, 2], [29871, 29871, 450], [235, 233, 450], [243, 162, 156, 134], [1, 450, 2, 450]])
def test_decode_of_any_ids(ids):
    assert PIECES.decode(ids) == SP.decode(ids)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in op7_sentencepiece(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = SP.encode(r.text, add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()


def test_nulls_and_empty_table(spark):
    schema = "doc_id long, text string, n_tokens int"
    got = tokenized(spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1)], schema)).collect()
    assert [r.n_tokens for r in got] == [1, 1, 1] and got[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert tokenized(spark.createDataFrame([], schema)).count() == 0
