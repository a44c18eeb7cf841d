"""Quality by positive-unlabelled learning: trusted positives, unlabelled texts, an estimated class prior, a non-negative risk."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.base import dropped, table, written
from vicinal.llm.flat import SPACE, mix64, parts, text_bytes, word_bounds, word_hashes
from vicinal.llm.toxicity import held_out

#: What a rate, a number of words, a mean and a greatest word length must exceed for the levels 1 to 9.
RATES = (0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
WORDS = (0, 1, 2, 5, 10, 20, 50, 100, 200)
MEAN = (1, 2, 3, 4, 5, 6, 8, 10, 15)
LONGEST = (5, 10, 15, 20, 30, 50, 100, 300, 1000)
TRAITS, LEVELS = 12, 9
#: Inputs of the model: one for each level that a trait reaches, and a constant.
SIZE = TRAITS * LEVELS + 1
#: Ridge of both fits, Newton steps at most, a step's shortest share, and where a document counts as good.
RIDGE, STEPS, HALVINGS, GOOD = 1e-3, 25, 8, 0.3
#: Bins of the scores from which the prior is read, and the chance of an error that its margin allows.
BINS, DELTA = 1_000, 0.1
#: Prior without anything to estimate it from.
EVEN = 0.5


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SIGN, _CALL, _STOP = _flags(b"#*$%&|<>"), _flags(b"!?"), _flags(b".,;:!?")
_UPPER, _LOWER, _DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), _flags(b"0123456789")


def _again(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n documents: values that its other values repeat, first ones included, and distinct values."""
    if not len(h):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(d)))
    many = times > 1
    return np.bincount(d[first][many], times[many], n).astype(np.int64), np.bincount(d[first], minlength=n)


def traits(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, TRAITS): levels, 0 to LEVELS, of whole texts given as bytes."""
    n = len(at) - 1
    starts, ends, first = word_bounds(buf, at)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    total = lambda flags: np.diff(upto(flags[buf])[at])
    per = lambda x, y: x / np.maximum(1, y)
    h = word_hashes(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    same = doc[1:] == doc[:-1]
    next_to = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n) if len(h) else np.zeros(n)
    whole = same[:-1] & same[1:] if len(h) > 2 else np.zeros(0, bool)
    three = mix64(mix64(h[:-2]) * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:] if len(h) > 2 else h[:0]
    again3, _ = _again(doc[:-2][whole] if len(h) > 2 else doc[:0], three[whole], n)
    _, distinct = _again(doc, h, n)
    # lines: between line feeds and the texts' ends, with something else than white space in them
    cut = np.unique(np.concatenate([at, np.flatnonzero(buf == 10) + 1]))
    lo, hi = cut[:-1], cut[1:] - (buf[np.maximum(cut[1:] - 1, 0)] == 10 if len(buf) else 0)
    solid = upto(~SPACE[buf])
    some = solid[hi] > solid[lo]
    lo, hi = lo[some], hi[some]
    line_doc = np.searchsorted(at, lo, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    _, line_kinds = _again(line_doc, word_hashes(buf, lo, hi) if len(lo) else np.zeros(0, np.uint64), n)
    size = ends - starts
    chars = np.bincount(doc, size, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, size)
    stop = np.bincount(doc[_STOP[buf[ends - 1]]], minlength=n) if len(ends) else np.zeros(n)
    up = total(_UPPER)
    rates = [per(total(_SIGN), words), per(up, up + total(_LOWER)), per(total(_CALL), words), per(next_to, words), per(again3, words), per(words - distinct, words), per(lines - line_kinds, lines), per(total(_DIGIT), chars), per(stop, words)]
    level = lambda x, over: np.searchsorted(over, x, "left")
    return np.stack([level(words, WORDS), level(per(chars, words), MEAN), level(longest, LONGEST), *(level(x, RATES) for x in rates)], 1)


def packed(levels: np.ndarray) -> np.ndarray:
    """Four bits a level: a text is one number, and texts alike are one row from then on."""
    return (levels.astype(np.int64) << (4 * np.arange(TRAITS))).sum(1)


def inputs(code: np.ndarray) -> np.ndarray:
    levels = (code[:, None] >> (4 * np.arange(TRAITS))) & 15
    over = levels[:, :, None] > np.arange(LEVELS)
    return np.concatenate([over.reshape(len(code), -1), np.ones((len(code), 1))], 1).astype(float)


def coded(docs: DataFrame) -> DataFrame:
    """A written table (doc_id, held_out, code), a row per row of docs; the only pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(packed(traits(*text_bytes(batch.column("text")))))], ["doc_id", "held_out", "code"])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, code long"), "codes")


def weighed(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """A written table (code, u, p): of the texts of each code, all, and the trusted ones. Trusted is an id that isn't held out and whose
    labels all say 1. Equal ids and codes are one row before ids meet labels."""
    good = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least")).filter("least = 1").select("doc_id", F.lit(1).alias("good"))
    each = codes.groupBy("doc_id", "code").agg(F.count("*").alias("n")).join(good, "doc_id", "left")
    return written(each.groupBy("code").agg(F.sum("n").alias("u"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("p")), "weights")


def summed(weights: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all codes of of(inputs, u, p), by partition and then on the driver: SIZE ** 2 numbers a partition at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = of(inputs(b.column("code").to_numpy()), b.column("u").to_numpy().astype(float), b.column("p").to_numpy().astype(float))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["x"])

    return sum((np.array(r.x) for r in weights.mapInArrow(run, "x array<double>").collect()), np.zeros(1))


def soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risks(z: np.ndarray, u: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of the logistic loss: of all texts as negatives, of the trusted ones as negatives and as positives."""
    return np.stack([u @ soft(z), p @ soft(z), p @ soft(-z)])


def minimised(weights: DataFrame, value: Callable[[np.ndarray], np.ndarray], slope: Callable, n_u: float, n_p: float) -> np.ndarray:
    """Newton's method with halved steps. slope(z, u, p) gives the losses' first and second derivatives by z for a row of the table;
    value(risks) the objective from mean risks."""
    w = np.zeros(SIZE)
    now = math.inf
    for _ in range(STEPS):

        def curve(x: np.ndarray, u: np.ndarray, p: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            a, b = slope(x @ w, u / n_u, p / n_p)
            return np.concatenate([x.T @ a, ((x * b[:, None]).T @ x).ravel()])

        got = summed(weights, curve)
        gradient, hessian = got[:SIZE] + RIDGE * w, got[SIZE:].reshape(SIZE, SIZE) + RIDGE * np.eye(SIZE)
        step = -np.linalg.solve(hessian, gradient)
        tries = np.stack([w + step * 0.5**k for k in range(HALVINGS)])
        sums = summed(weights, lambda x, u, p, tries=tries: risks(x @ tries.T, u / n_u, p / n_p).ravel()).reshape(3, HALVINGS)
        values = value(sums) + RIDGE / 2 * (tries**2).sum(1)
        k = int(values.argmin())
        if not values[k] < now - 1e-9:
            break
        w, now = tries[k], values[k]
    return w


def apart(weights: DataFrame, n_u: float, n_p: float) -> np.ndarray:
    """A logistic model that tells trusted from all texts, each half of the weight."""

    def slope(z: np.ndarray, u: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = sigmoid(z)
        return u * s - p * (1 - s), (u + p) * s * (1 - s)

    return minimised(weights, lambda r: r[0] + r[2], slope, n_u, n_p)


def totals(weights: DataFrame) -> tuple[float, float]:
    n = weights.agg(F.sum("u").alias("u"), F.sum("p").alias("p")).first()
    return float(n.u or 0), float(n.p or 0)


def by_chance(n_u: float, n_p: float) -> float:
    """How far a share among all and one among trusted texts may both be off, but for a chance of DELTA."""
    return math.sqrt(math.log(4 / DELTA) / 2 / n_u) + math.sqrt(math.log(4 / DELTA) / 2 / n_p)


def prior(weights: DataFrame, n_u: float, n_p: float) -> float:
    """The share of positives among all texts: the least ratio of all to trusted texts above a score, over all scores, with a margin
    for chance. Where trusted texts score best, all texts there are positives, and the ratio is the share. Scores come from a model
    that tells trusted from all texts; each half of the codes is scored by the model of the other, which hasn't seen them."""

    def bins(x: np.ndarray, u: np.ndarray, p: np.ndarray, w: np.ndarray) -> np.ndarray:
        k = np.minimum((sigmoid(x @ w) * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(k, u, BINS), np.bincount(k, p, BINS)])

    half = F.pmod(F.xxhash64("code"), F.lit(2))
    got = np.zeros(2 * BINS)
    for k in range(2):
        seen = weights.filter(half == k)
        n = totals(seen)
        w = apart(seen, *n) if all(n) else np.zeros(SIZE)
        got = got + summed(weights.filter(half != k), lambda x, u, p, w=w: bins(x, u, p, w))
    above = lambda x: np.cumsum(x[::-1])
    q_u, q_p = above(got[:BINS]) / n_u, above(got[BINS:]) / n_p
    margin = by_chance(n_u, n_p)
    some = q_p > 0
    best = np.argmin((q_u[some] + margin) / q_p[some])
    return float(min(1.0, q_u[some][best] / q_p[some][best]))


def fit(weights: DataFrame) -> tuple[np.ndarray, float]:
    """(w, prior). The risk of a text that is positive with the prior's share, from trusted and all texts only: trusted as positives,
    plus all as negatives less the trusted ones' part in it. That difference estimates a risk, which is never below 0; where it is, by
    more than chance explains, the model has learned the trusted texts by heart. It begins above 0, and a step is shortened until
    it isn't below that bound and the whole falls; the bound goes to 0 as texts grow in number."""
    n_u, n_p = totals(weights)
    if not n_u or not n_p:
        return np.zeros(SIZE), EVEN
    share = prior(weights, n_u, n_p)
    chance = by_chance(n_u, n_p)

    def slope(z: np.ndarray, u: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = sigmoid(z)
        return u * s - share * p, u * s * (1 - s)

    def value(r: np.ndarray) -> np.ndarray:
        less = r[0] - share * r[1]
        return np.where(less >= -chance, share * r[2] + less, math.inf)

    return minimised(weights, value, slope, n_u, n_p), share


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, prior.

    Null and empty texts have the traits of a text without words and the score that goes with them. A null id isn't held out and has
    no label. Repeated rows get a row each and the same score, and each counts as a text; an id whose labels differ isn't trusted.
    Without trusted texts every score is 0.5. Texts of any length are read whole; no documents give no rows; other columns, labels
    and ids included, never are inputs.
    """
    codes = coded(docs)
    weights = weighed(codes, labels)
    w, share = fit(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = sigmoid(inputs(b.column("code").to_numpy()) @ w)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= GOOD).astype(np.int32)), pa.array(np.full(len(score), share))], ["doc_id", "held_out", "score", "predicted", "prior"])

    out = written(codes.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, prior double"), "quality")
    dropped(codes, weights)
    return out


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
