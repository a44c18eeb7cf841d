"""Toxicity: words restored from disguise by a noisy-channel decoder, then scored by what the labels say about them."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.base import table, written
from vicinal.llm.flat import parts

#: Letters of the language model: Latin lower case with accents; 0 is anything else, a word's edge.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SIZE = len(LETTERS) + 1
PLACE = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What a sign may stand for, and the costs (in nats) of reading it so, of dropping a repeated letter, a separator, another sign, and of
#: taking a digit for a digit.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "¡": "i", "£": "l"}
SWAP, REPEAT, JOIN, DROP, NUMBER = 1.0, 0.7, 0.5, 2.5, 4.0
JOINERS = " .-_*"
#: Labelled rows that the model is learned from, those of least hash; features of FEWEST toxic documents at least.
SAMPLE, FEWEST = 10_000, 4
#: Word beginnings of these lengths are features beside whole words.
STEMS = (4, 5, 6, 7)
#: Tokens whose words a worker keeps; a full store starts anew.
STORE = 200_000

WORDS = re.compile(r"[^\W\d_]+")
#: Letters one by one, with a space between.
SINGLE = re.compile(r"[^\W_]|[@$!|+€]")
THRICE = re.compile(r"([^\W\d_])\1\1")
LETTER = re.compile(r"[^\W\d_]")
#: A sign that may stand for a letter or join letters.
SIGN = re.compile("[" + re.escape("".join(LEET) + JOINERS) + "]")
#: Marks that may stand before and behind a word.
BEFORE, BEHIND = frozenset("\"'([{<«#%&*"), frozenset("\"')]}>».,;:?!#%&*")
CODE = np.zeros(0x110000, np.uint8)
CODE[[ord(c) for c in LETTERS]] = range(1, SIZE)


def readings(c: str, before: str) -> list[tuple[str, float]]:
    """What the channel may have made c from, and the cost: letters, nothing, or (a space) itself, apart from all letters."""
    if c in PLACE:
        return [(c, 0.0)] + ([("", REPEAT)] if c == before else [])
    out = [(x, SWAP) for x in LEET.get(c, "")]
    out.append(("", JOIN if c in JOINERS else DROP))
    return out + ([(" ", NUMBER)] if c.isdigit() else [])


def ends(t: str) -> str:
    """t without what can only be dropped at its ends, which says nothing there."""
    solid = lambda c: c.isalnum() or c == "_" or c in LEET
    i, j = 0, len(t)
    while i < j and not solid(t[i]):
        i += 1
    while j > i and not solid(t[j - 1]):
        j -= 1
    return t[i:j]


def edge(t: str) -> str:
    """t without marks before it, and without marks or one repeated sign behind it."""
    i, n = 0, len(t)
    while i < n and t[i] in BEFORE:
        i += 1
    j = k = n
    while j > i and t[j - 1] in BEHIND:
        j -= 1
    if n > i and not (t[-1].isalnum() or t[-1] == "_" or t[-1].isspace()):
        while k > i and t[k - 1] == t[-1]:
            k -= 1
    return t[i : min(j, k) if n - k > 1 else j]


class Channel:
    """Restores disguised words under a trigram model of letters."""

    def __init__(self, counts: np.ndarray) -> None:
        c3 = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        c2, c1 = c3.sum(2), c3.sum((0, 1))
        one = (c1 + 0.5) / (c1.sum() + 0.5 * SIZE)
        two = (c3.sum(0) + 5 * one) / (c3.sum((0, 2))[:, None] + 5)
        self.log = np.log((c3 + 5 * two[None]) / (c2[:, :, None] + 5)).tolist()
        self.known: dict[str, tuple[str, ...]] = {}

    def step(self, a: int, b: int, x: str) -> tuple[int, int, float]:
        """The two letters after x was read behind a and b, and x's log-likelihood. A space ends a word; no second one does."""
        if x == "":
            return a, b, 0.0
        if x == " ":
            return 0, 0, self.log[a][b][0] if b else 0.0
        k = PLACE[x]
        return b, k, self.log[a][b][k]

    def best(self, seen: str) -> tuple[float, str]:
        """The likeliest text behind a lower-case string and its log-likelihood: Viterbi over the lattice of readings. The state is the
        last two letters, which is all that the language model asks for, so no path that could win is dropped; paths share their
        beginnings, so memory and time follow the length."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for c in seen:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, path) in states.items():
                for x, cost in readings(c, before):
                    i, j, q = self.step(a, b, x)
                    q += p - cost
                    if (i, j) not in after or after[i, j][0] < q:
                        after[i, j] = (q, (x, path) if x else path)
            states = after
            before = c
        p, path = max(((p + self.step(a, b, " ")[2], path) for (a, b), (p, path) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return p, "".join(reversed(out))

    def decode(self, seen: str) -> str:
        return self.best(seen)[1]

    def of_token(self, t: str) -> tuple[str, ...]:
        """Words of a lower-case token: as it stands, and restored."""
        if t in self.known:
            return self.known[t]
        found = set(WORDS.findall(t))
        odd = {w for w in found if THRICE.search(w)}
        if not t.isalpha():
            # marks at the ends may be letters ("a$$") or marks ("idiot!!"): both ways are read, the costs decide on the rest
            odd |= {x for x in (ends(t), edge(edge(t))) if THRICE.search(x) or (LETTER.search(x) and SIGN.search(x))}
        for x in odd:
            found.update(self.decode(x).split())
        out = tuple(sorted(found))
        if len(self.known) >= STORE:
            self.known.clear()
        self.known[t] = out
        return out

    def words(self, text: str) -> set[str]:
        """All distinct words of the whole restored text, in lower case; what wasn't restored counts too."""
        low = text.lower().split()
        found: set[str] = set()
        for t in set(low):
            found.update(self.known[t] if t in self.known else self.of_token(t))
        run: list[str] = []
        for t in [*low, "  "] if sum(len(t) == 1 for t in low) > 2 else ():
            if len(t) == 1 and SINGLE.match(t):
                run.append(t)
            else:
                if len(run) > 2:
                    found.update(self.decode(" ".join(run)).split())
                run = []
        return found


def features(words: set[str]) -> set[str]:
    """Words, and their beginnings (marked by a trailing -)."""
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for whole in batches:
        for batch in parts(whole):
            text = "  ".join(t for t in batch.column("text").to_pylist() if t).lower()
            c = CODE[np.frombuffer(f"  {text}  ".encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
            at = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
            total += np.bincount(at, minlength=SIZE**3)
    total[0] = 0
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])


def letter_model(docs: DataFrame) -> Channel:
    """From the letter trigrams of all texts: tasks count, sums come to the driver, SIZE ** 3 numbers at most."""
    counts = np.zeros(SIZE**3, np.int64)
    for r in docs.select("text").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    return Channel(counts)


class Model:
    """odds: what each feature says; weights: of the doc's strongest features, bias first."""

    def __init__(self, odds: dict[str, float], weights: list[float]) -> None:
        self.odds, self.weights = odds, weights
        self.said: dict[str, float] = {}

    def says(self, word: str) -> float:
        """A word says as much as its strongest feature."""
        if word not in self.said:
            if len(self.said) >= STORE:
                self.said.clear()
            self.said[word] = max([self.odds.get(word, 0.0), *(self.odds.get(word[:n] + "-", 0.0) for n in STEMS if len(word) > n)])
        return self.said[word]

    def strongest(self, words: set[str]) -> list[float]:
        """The three largest log-odds of a word."""
        top = heapq.nlargest(3, map(self.says, words))
        return top + [0.0] * (3 - len(top))

    def score(self, words: set[str]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.strongest(words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> list[float]:
    """Newton's method with a ridge; weights, bias first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, channel: Channel, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows that aren't held out; three quarters teach features, the others their weights.

    Copies and near copies would make any word of theirs look telling, so documents with the same sketch (least hash of
    three words in a row) count once.
    """
    pick = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = pick.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in parts(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                words = [channel.words(t) for t in texts]
                plain = [WORDS.findall(t.lower()) for t in texts]
                sketch = [min((xxhash.xxh64_intdigest(" ".join(x[i : i + 3])) for i in range(max(1, len(x) - 2))), default=0) >> 1 for x in plain]
                yield pa.RecordBatch.from_arrays([pa.array(sketch, pa.int64()), batch.column("toxic"), batch.column("weigh"), batch.column("order"), batch.column("doc_id"), pa.array(list(map(sorted, words)), pa.list_(pa.string()))], ["sketch", "toxic", "weigh", "order", "doc_id", "words"])

    weigh = F.pmod(F.xxhash64(F.lit("weigh"), "doc_id"), F.lit(4)) == 0
    order = F.xxhash64("doc_id", "text")  # of documents with one sketch the one of least hash counts, wherever it was read
    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), weigh.alias("weigh"), order.alias("order"), "doc_id")
    rows = rows.mapInArrow(extract, "sketch long, toxic int, weigh boolean, order long, doc_id long, words array<string>")
    rows = rows.groupBy("sketch").agg(F.min(F.struct("order", "doc_id", "toxic", "weigh", "words")).alias("one"))
    rows = written(rows.select("one.toxic", "one.weigh", "one.words"), "labelled")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, words in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
                for f in features(set(words)):
                    seen.setdefault(f, [0, 0])[toxic > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["feature", "no", "yes"])

    teach = rows.filter("not weigh")
    n = {r.toxic: r.n for r in teach.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    yes, no = n.get(True, 0), n.get(False, 0)
    if not yes or not no:
        return Model({}, [-2.0, 0.0, 0.0, 0.0])
    counted = teach.select("toxic", "words").mapInArrow(tell, "feature string, no long, yes long").groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).filter(F.col("yes") >= FEWEST)
    # the log of the odds ratio less two standard errors
    sure = F.log((F.col("yes") + 0.5) / (yes + 1.0)) - F.log((F.col("no") + 0.5) / (no + 1.0)) - 2 * F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5) * F.when(F.col("no") > 0, 1.0).otherwise(0.0))
    odds = {r.feature: r.sure for r in counted.withColumn("sure", sure).filter("sure > 0.7").collect()}  # of a bounded sample
    model = Model(odds, [])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([model.strongest(set(w)) for w in batch.column("words").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x[:, k]) for k in range(3))], ["toxic", "x0", "x1", "x2"])

    got = rows.filter("weigh").select("toxic", "words").mapInArrow(weighed, "toxic int, x0 double, x1 double, x2 double").toPandas().sort_values(["toxic", "x0", "x1", "x2"])  # a quarter of the sample
    y = (got.toxic.to_numpy() > 0).astype(float)
    model.weights = logistic(got[["x0", "x1", "x2"]].to_numpy(), y) if 0 < y.sum() < len(y) else [-3.0, 1.0, 0.0, 0.0]
    return model


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts score as texts without words; a null id isn't held out; without labels of both kinds every score is
    the same, under 0.5. Texts of any length are read whole, and a token of any length is decoded. Repeated rows get a row each
    and the same score; of labels that differ for one id the toxic one counts; of documents alike the one of least hash is learned
    from, so scores don't depend on how rows are dealt. No documents give no rows; labels, lang, source and other columns never
    are inputs.
    """
    channel = letter_model(docs)
    model = fit(docs, labels, channel, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                scores = np.array([model.score(channel.words(t or "")) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
