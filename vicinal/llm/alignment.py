"""Alignment of two tokenizers over all texts: which tokens cover the same bytes, and how often they do so in the corpus."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.llm.base import dropped, table, written

#: A pair of ids is one number: A's id << SHIFT | B's.
SHIFT = 15
#: Segments that a worker keeps; segments over LONG characters are encoded alone and not kept; others in runs of about RUN characters.
STORE, LONG, RUN = 120_000, 1_000, 20_000
#: Characters of text that a worker aligns at once, a whole text at least.
AT_ONCE = 1 << 19
#: Pairs of ids, 40 MB as a hash table, up to which their counts are broadcast; beyond it they meet the links in a shuffle, SALT ways.
BROADCAST, SALT = 1_000_000, 8
#: A space between other characters: no token of either side reaches over its left end. It begins the next segment, as a space begins a text.
CUT = re.compile(r"(?<=\S) (?=\S)")
KIND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def ends_merged(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two-pointer merge of two ascending lists of token ends: the distinct ends, the token of either side that each stretch up to an end
    lies in, and whether both sides end there. A stretch is a pair of tokens that overlap, and no pair has two."""
    both = np.concatenate([ea, eb])
    both.sort(kind="stable")  # of two runs: a merge
    cut = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    ia, ib = np.searchsorted(ea, cut), np.searchsorted(eb, cut)
    return cut, ia, ib, (ea[ia] == cut) & (eb[ib] == cut) if len(cut) else np.zeros(0, bool)


class Sides:
    """Both tokenizers, and what is known of segments: a segment's tokens, groups and links don't depend on what stands around it."""

    def __init__(self, ranks: bytes, json: str, model: bytes) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.json, self.whole = json, None
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_len = np.zeros(max(table.values()) + 2, np.int64)
        self.a_len[list(table.values())] = [len(x) for x in table]
        pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_len = np.array(list(map(len, self.b_bytes)), np.int64)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; -1 for a segment whose bytes differ
        self.links, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def runs(self, segments: list[str]) -> Iterator[list[str]]:
        """Segments to encode at once; one that white space begins or ends, as at a text's ends, is encoded alone."""
        run, size = [], 0
        for s in segments:
            if s != s.strip() or not s:
                yield [s]
                continue
            if run and size + len(s) > RUN:
                yield run
                run, size = [], 0
            run.append(s)
            size += len(s) + 1
        if run:
            yield run

    def ids(self, run: list[str]) -> Iterator[tuple[list[str], np.ndarray | None, np.ndarray | None]]:
        """Ids of a run of segments; none for a segment whose tokens' bytes aren't its own. If the whole's aren't, each is tried alone."""
        text = " ".join(run)
        b = self.sp.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != f" {text}".encode():
            if len(run) == 1:
                yield run, None, None
            else:
                for s in run:
                    yield from self.ids([s])
            return
        a = self.fast.encode_ordinary(" " + text) if len(text) <= 2 * RUN else self.slow(" " + text)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        yield (run, a, b) if self.a_len[a].sum() == self.b_len[b].sum() else (run, None, None)

    def slow(self, text: str) -> list[int]:
        """The same ids, in time that follows the length of a segment, however long; loaded once it is needed."""
        from tokenizers import Tokenizer

        if not self.whole:
            self.whole = Tokenizer.from_str(self.json)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids

    def learn(self, segments: list[str]) -> None:
        order, a_all, b_all, ok = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for run in self.runs(segments):
            for some, a, b in self.ids(run):
                order += some
                ok += [a is not None] * len(some)
                if a is not None:
                    a_all.append(a)
                    b_all.append(b)
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        good = np.array(ok, bool)
        size = np.where(good, np.array([len(s.encode()) + 1 for s in order], np.int64), 0)
        end = np.cumsum(size)
        ea, eb = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        cut, ia, ib, both = ends_merged(ea, eb)
        n = len(order)
        of = lambda e: np.searchsorted(end, e)  # noqa: E731  the segment that a byte offset ends in
        seg_a, seg_b, seg_link = of(ea), of(eb), of(cut)
        count = lambda x: np.bincount(x, minlength=n)
        sizes = np.stack([count(seg_a), count(seg_b), count(seg_link[both]), count(seg_link)], 1)
        sizes[~good] = -1
        # decimal ids by group, A's before B's, each with the mark that follows it
        ends = cut[both]
        last_a, last_b = np.isin(ea, ends, assume_unique=True), np.isin(eb, ends, assume_unique=True)
        group = np.concatenate([np.searchsorted(ends, ea), np.searchsorted(ends, eb)])
        place = np.argsort(group * 2 + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        mark = np.concatenate([np.where(last_a, "|", ","), np.where(last_b, ";", ",")])[place].tolist()
        flat = [f"{i}{m}" for i, m in zip(np.concatenate([a, b])[place].tolist(), mark, strict=True)]
        upto = np.concatenate([[0], np.cumsum(count(seg_a) + count(seg_b))]).tolist()
        base = len(self.texts)
        self.texts += ["".join(flat[i:j])[:-1] for i, j in zip(upto, upto[1:], strict=False)]
        self.known.update(zip(order, range(base, base + n), strict=True))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.links = np.concatenate([self.links, (a[ia] << SHIFT | b[ib]).astype(np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(count(seg_link))])

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, groups_sha256, its distinct linked pairs and how often each is linked."""
        cut = [CUT.split(t) if t else [] for t in texts]
        wanted = {s for x in cut for s in x}
        if len(self.known) + len(wanted) > STORE:
            self.clear()
        self.learn([s for s in wanted if s not in self.known])
        size = np.array(list(map(len, cut)))
        seg = np.array([self.known[s] for x in cut for s in x], np.int64)
        doc = np.repeat(np.arange(len(cut)), size)
        bad = np.zeros(len(cut), bool)
        bad[doc[self.sizes[seg, 0] < 0]] = True
        bad |= size == 0
        on = ~bad[doc]
        sums = np.stack([np.bincount(doc[on], self.sizes[seg[on], k], len(cut)).astype(np.int64) for k in range(4)], 1)
        first, n = self.at[seg[on]], self.sizes[seg[on], 3]
        start = np.cumsum(n) - n
        pair = self.links[np.repeat(first - start, n) + np.arange(n.sum())]
        key, times = np.unique(np.repeat(doc[on], n) << 31 | pair, return_counts=True)
        at = np.searchsorted(key >> 31, np.arange(len(cut) + 1))
        pair, times = (key & 0x7FFFFFFF).astype(np.int32), times.astype(np.int32)
        said = iter(map(self.texts.__getitem__, seg.tolist()))
        for i in range(len(cut)):
            own = [next(said) for _ in range(size[i])]
            sha = "" if bad[i] else hashlib.sha256(";".join(own).encode()).hexdigest()
            yield (*sums[i].tolist(), sha, pair[at[i] : at[i + 1]], times[at[i] : at[i + 1]])
        if any(len(s) > LONG for s in wanted):  # not kept: a store holds short segments
            self.clear()


_LOADED: dict[str, Sides] = {}


def files(path: str | None = None) -> tuple[bytes, str, bytes]:
    """The vocabularies, 3 MB whatever the input; they go with the tasks. The first has the second's vocabulary as ranks."""
    import public_tokenizers

    place = (lambda n: f"{path}/{n}") if path else public_tokenizers.path
    read = lambda n: open(place(n), "rb").read()
    return read("byte_bpe_50k.tiktoken"), read("byte_bpe_50k.json").decode(), read("piece_bpe_32k.model")


def aligned(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A written table with a row per row of docs, told apart by `row`: sizes, the hash of its groups, its linked pairs."""
    given = files(path)
    key = hashlib.sha256(b"".join(x if isinstance(x, bytes) else x.encode() for x in given)).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(given)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _LOADED:
            _LOADED[key] = Sides(*sent.value)
        sides = _LOADED[key]
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            i = 0
            while i < len(texts):
                j, total = i, 0
                while j < len(texts) and (j == i or total + len(texts[j]) <= AT_ONCE):
                    total += len(texts[j])
                    j += 1
                rows = list(sides.align(texts[i:j]))
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                out.insert(0, "doc_id", frame["doc_id"].iloc[i:j].astype("Int64").astype(object).to_numpy())
                yield out
                i = j

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, KIND)
    return written(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def counted(links: DataFrame) -> DataFrame:
    """A written table of pairs: in how many rows each is linked, and whether that is the most of any pair with its A id."""
    n = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # an A id has as many pairs as B has ids, at most
    most = F.max("n").over(W.partitionBy(F.shiftright("pair", SHIFT)))
    return written(n.withColumn("best", (F.col("n") == most).cast("int")), "pairs")


def alignment(docs: DataFrame, path: str | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose tokens' bytes aren't the text's (it holds U+2581), has zeros and an empty string; so has every
    row of no corpus at all. Repeated rows get a row each and count as a document each; a null id is an id. Texts of any length are
    encoded whole, by segments; an empty table gives no rows; extra columns are ignored. Ties for an A id's highest count all
    count as best. `broadcast`: up to how many pairs counts are broadcast; the rows don't depend on it.
    """
    links = aligned(docs, path)
    pairs = counted(links)
    each = links.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    if pairs.count() <= broadcast:
        met = each.join(F.broadcast(pairs), "pair")
    else:
        dealt = pairs.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
        met = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(dealt, ["pair", "salt"])
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = links.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    out = written(out, "alignment")
    dropped(links, pairs)
    return out


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
