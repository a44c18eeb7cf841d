import itertools
import time
import zlib

import numpy as np

from vicinal.llm import toxicity
from vicinal.llm.toxicity import SIZE, letter_model, op8_toxicity, readings, scored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y > 0
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = op8_toxicity(spark, sf).toPandas()
    assert len(got) == 10000 and got.doc_id.is_unique and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    y = both.toxic.to_numpy()
    accuracy, area = (both.predicted == y).mean(), auc(y, both.score.to_numpy())
    print("held-out accuracy", accuracy, "AUC", area, "recall", both.predicted[y == 1].mean(), "precision", y[both.predicted == 1].mean())
    assert accuracy > 0.93 and area > 0.9


def test_disguises_are_restored(spark):
    channel = letter_model(spark.createDataFrame([("the idiot was here and an idiot is a clown worthless",)] * 50, "text string"))
    for seen in ("1d1ot", "idiooooot", "i d i o t", "i.d.i.o.t", "!d!0t", "id10t"):
        assert "idiot" in channel.words(f"so {seen} it"), seen
    assert len(channel.log) == SIZE and channel.words("") == set() and channel.words("plain words") == {"plain", "words"}


def test_odd_rows(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i * 7919:06d}")
    rows = [(i, f"{name(i)} says {name(i + 1)} {'moron' if i % 3 == 0 else 'friend'} {name(i + 2)}", None, None, None) for i in range(400)]
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "you m0r0n", None, None, None), (None, "moron", None, None, None), (1003, "ab" * 100000, None, None, None)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in scored(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(got) == len(rows) and got[1002].predicted == 1 and got[1000].score == got[1001].score < 0.5 and got[None].predicted == 1 and not got[None].held_out
    none = scored(spark.createDataFrame(rows[:3], DOCS), labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert scored(spark.createDataFrame([], DOCS), labels).count() == 0


def test_disguises_at_any_place_are_restored(spark):
    channel = letter_model(spark.createDataFrame([("the idiot and the whore said shit, bitch, girl; an ass is an idiot in the class",)] * 50, "text string"))
    for seen, word in (("idio7", "idiot"), ("1d10t", "idiot"), ("whor3", "whore"), ("a$$", "ass"), ("5h17", "shit"), ("8itch", "bitch"), ("9irl", "girl"), ("|diot", "idiot"), ('"idio+!",', "idiot"), ("1d1ot!!", "idiot")):
        assert word in channel.words(f"so {seen} it"), seen
    assert channel.words("plain, words. (1999) it's 50 % 'so'") == {"plain", "words", "it", "s", "so"}


def test_decoder_against_all_paths(spark):
    """Viterbi's best path is as likely as the best of all readings, each scored letter by letter."""
    channel = letter_model(spark.createDataFrame([("the idiot was here, dumbass and moron; room 101 is a class of its own",)] * 20, "text string"))
    for seen in ("1d10t", "dumba55", "dumba$$", "idio7", "tra5h", "m0r0n", "aabbb", "r00m101", "1-1", "a.b-c", "l0l!", "x99", "8itch", "ßb4"):
        choices = [readings(c, seen[i - 1] if i else "") for i, c in enumerate(seen)]
        best = -1e9
        for path in itertools.product(*choices):
            a = b = 0
            p = 0.0
            for x, cost in path:
                a, b, q = channel.step(a, b, x)
                p += q - cost
            best = max(best, p + channel.step(a, b, " ")[2])
        found, text = channel.best(seen)
        assert abs(found - best) < 1e-9, seen
    for seen, word in (("1d10t", "idiot"), ("idio7", "idiot"), ("dumba55", "dumbass"), ("dumba$$", "dumbass"), ("m0r0n", "moron")):
        assert channel.decode(seen) == word
    assert len(channel.best("a1" * 20_000)[1]) > 0 and channel.best("") == (0.0, "")


def test_reruns_and_repeats_agree(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    first = {r.doc_id: r.score for r in scored(docs, labels).collect()}
    again = scored(docs.repartition(7, "text").union(docs.limit(5)).withColumns({"score": docs.n_chars, "toxic": docs.n_chars}), labels.repartition(3)).collect()
    assert len(again) == len(first) + 5 and all(r.score == first[r.doc_id] for r in again)


def test_long_runs_of_marks_take_time_by_their_length():
    channel = toxicity.Channel(np.ones(toxicity.SIZE**3, np.int64))
    began = time.time()
    for t in ("a" + "*" * 1_000_000 + "b", "*" * 1_000_000, "a" + "!" * 20_000 + "b", "." * 500_000 + "a$$" + ";" * 500_000, "x" * 1_000_000, "~" * 1_000_000 + "a"):
        channel.words(t)
    assert time.time() - began < 60
    assert toxicity.ends("**a$$**") == "a$$" and toxicity.edge("((idiot!!") == "idiot" and toxicity.edge("a~~") == "a" and toxicity.edge("...") == "" and toxicity.edge("a~") == "a~"
