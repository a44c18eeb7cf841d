"""Repeated byte strings across documents by suffix arrays: Larsson-Sadakane refinement, Kasai's common prefixes, merging of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.base import row_key, table, written
from vicinal.llm.flat import _powers, mix64, numbers, parts, text_bytes

#: Strings of this many bytes that start anywhere else too are removed.
LENGTH = 200
#: A string is looked up under the least hash among its substrings of this many bytes.
GRAM = 64
#: Bytes that a shard holds about, and contexts of one anchor in a shard: a commoner anchor is dealt to several shards.
SHARD, PIECE = 4 << 20, 1_000
#: A number for each byte, for the hash of grams. It only groups: grams that it takes for one share a shard, where bytes decide.
_BYTE = numbers(256, 31)


def rolled(buf: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place on."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf))
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * down[: len(buf)], out=run[1:])
    return mix64((run[size:] - run[:-size]) * up[:n])


def anchors(buf: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each string of `length` bytes within a text has an anchor: the first of its grams of least hash. Runs of strings with one
    anchor: (text, hash, first start, number of strings). Equal strings have equal anchors at equal distance."""
    h = rolled(buf, gram)
    wide = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none.view(np.uint64), none, none
    v, i, have = h, np.arange(len(h)), 1
    while have < wide:
        step = min(have, wide - have)
        left = v[:-step] <= v[step:]
        v, i = np.where(left, v[:-step], v[step:]), np.where(left, i[:-step], i[step:])
        have += step
    start = np.arange(len(i))
    text = np.searchsorted(at, start, side="right") - 1
    ok = start + length <= at[text + 1]
    start, text, i = start[ok], text[ok], i[ok]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return text[first], h[i[first]], start[first], np.diff(np.append(first, len(i)))


def suffix_array(words: np.ndarray, end: np.ndarray, first: np.ndarray, terminal: np.ndarray) -> np.ndarray:
    """All suffixes of all strings in order; a string's end comes before every byte, an earlier string's end before a later one's.

    words: 8 bytes from each place on, as a number; end: place of the end of the string that a place is in; first: places to
    sort; terminal: the ends. Larsson and Sadakane: suffixes in one group agree on h bytes; a group is sorted by the group of
    what follows after h bytes, then h doubles. Groups of one are never touched again.
    """
    order = first[np.argsort(words[first], kind="stable")]
    rank = np.zeros(len(words), np.int64)
    rank[terminal] = np.arange(len(terminal))
    base = len(terminal)
    key = words[order]

    def heads(same: np.ndarray) -> np.ndarray:
        """Place of each element's group's head."""
        return np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))

    same = np.concatenate([[False], key[1:] == key[:-1]])
    head = heads(same)
    rank[order] = head + base
    h = 8
    alive = np.flatnonzero(same | np.append(same[1:], False))
    while len(alive):
        p = order[alive]
        group, after = head[alive], rank[np.minimum(p + h, end[p])]
        by = np.lexsort((after, group))
        order[alive] = p[by]
        group, after = group[by], after[by]
        same = np.concatenate([[False], (group[1:] == group[:-1]) & (after[1:] == after[:-1])])
        new = np.maximum.accumulate(np.where(same, 0, alive))
        head[alive] = new
        rank[order[alive]] = new + base
        alive = alive[same | np.append(same[1:], False)]
        h *= 2
    return order


def common_prefixes(words: np.ndarray, end: np.ndarray, order: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each place the length of the common prefix with the suffix before it in order.

    Kasai: from one place to the next the length falls by one at most. The strings go side by side, eight bytes at a time.
    """
    before = np.full(len(words), -1)
    before[order[1:]] = order[:-1]
    out = np.zeros(len(words), np.int64)
    by = np.argsort(-size, kind="stable")
    start, size = start[by], size[by]
    h = np.zeros(len(start), np.int64)
    for t in range(int(size.max()) if len(size) else 0):
        n = np.searchsorted(-size, -t, side="left")
        i = start[:n] + t
        j = before[i]
        h = np.where(j >= 0, np.maximum(h[:n] - 1, 0), 0)
        most = np.where(j >= 0, np.minimum(end[i] - i, end[j] - j), 0)
        on = np.flatnonzero(h < most)
        while len(on):
            x = words[i[on] + h[on]] ^ words[j[on] + h[on]]
            same = (x == 0).astype(np.int64)
            for k in range(1, 8):
                same += x < np.uint64(1 << (8 * k))
            h[on] = np.minimum(h[on] + same, most[on])
            on = on[(same == 8) & (h[on] < most[on])]
        out[i] = h
    return out


_MARKS = pa.schema([("hash", pa.int64()), ("d", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32())])


def _shard(rows: pa.Table) -> pa.Table:
    """A shard's contexts: runs of strings found twice or more in it, and, of anchors dealt to several shards, the fingerprint
    of every different string (stop is -1 where the string was found once)."""
    hash_, d, again, pieces, piece = (rows.column(c).to_numpy() for c in ("hash", "d", "again", "pieces", "piece"))
    ctx = rows.column("ctx").combine_chunks()
    some = np.flatnonzero(~np.asarray(ctx.is_null()))
    key = np.column_stack([hash_, d])
    _, take, which = np.unique(key[some], axis=0, return_index=True, return_inverse=True)
    which = which.reshape(-1)
    many = np.bincount(which, minlength=len(take)) > 1
    twice = {(a, b) for a, b in key[again].tolist()}
    take = some[take]
    many |= np.array([tuple(x) in twice for x in key[take].tolist()], bool)
    got = ctx.take(pa.array(take))
    buf, at = text_bytes(got)
    size = np.diff(at)
    start = at[:-1] + 8 * np.arange(len(size))  # eight empty bytes after each
    flat = np.zeros(len(buf) + 8 * len(size) + 8, np.uint8)
    where = np.arange(len(buf)) + np.repeat(8 * np.arange(len(size)), size)
    flat[where] = buf + 1  # no byte of UTF-8 is 255
    words = np.zeros(len(flat), np.uint64)
    for k in range(8):
        words[: len(flat) - k] |= flat[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    end = np.repeat(start + size, size + 8)
    end = np.append(end, np.full(8, len(flat) - 1))
    order = suffix_array(words, end, where, start + size)
    lcp = common_prefixes(words, end, order, start, size)
    long_ = np.zeros(len(flat), bool)
    joined = lcp[order] >= LENGTH  # with the one before
    long_[order[joined]] = True
    long_[order[:-1][joined[1:]]] = True
    valid = np.zeros(len(flat), bool)
    own = np.repeat(np.arange(len(size)), size)
    valid[where[where + LENGTH <= (start + size)[own]]] = True
    of = np.zeros(len(flat), np.int64)
    of[where] = own
    marked = valid & (long_ | many[of])
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = [(hash_[take][of[a]], d[take][of[a]], a - start[of[a]], b - 1 + LENGTH - start[of[a]], np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.full(len(a), -1), pieces[take][of[a]])]
    dealt = pieces[take] > 1
    rep = order[~joined]
    rep = rep[valid[rep] & dealt[of[rep]]]
    if len(rep):
        data = flat.tobytes()
        fp = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[r : r + LENGTH]) for r in rep.tolist()), np.int64).reshape(-1, 2).T
        out.append((hash_[take][of[rep]], d[take][of[rep]], rep - start[of[rep]], np.where(marked[rep], -2, -1), *fp, piece[take][of[rep]], pieces[take][of[rep]]))
    return pa.table([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, t in zip(zip(*out, strict=True), _MARKS.types, strict=True)], schema=_MARKS)


def _merge(rows: pa.Table) -> pa.Table:
    """Strings found once in their shard that another shard has too: each shard's fingerprints are searched in all others'."""
    fp = np.zeros(len(rows), [("a", np.int64), ("b", np.int64)])
    fp["a"], fp["b"] = rows.column("fp1").to_numpy(), rows.column("fp2").to_numpy()
    stop, piece = rows.column("stop").to_numpy(), rows.column("piece").to_numpy()
    every = np.sort(fp)
    hit = np.zeros(len(fp), bool)
    for p in np.unique(piece):
        own = np.flatnonzero((piece == p) & (stop == -1))
        mine = np.sort(fp[piece == p])
        count = lambda s, x: np.searchsorted(s, x, "right") - np.searchsorted(s, x, "left")
        hit[own] = count(every, fp[own]) > count(mine, fp[own])
    start = rows.column("start").to_numpy()[hit]
    zero = np.zeros(hit.sum(), np.int64)
    return pa.table([rows.column("hash").to_numpy()[hit], rows.column("d").to_numpy()[hit], start, (start + LENGTH).astype(np.int32), zero, zero, np.full(hit.sum(), -1, np.int32), rows.column("pieces").to_numpy()[hit]], schema=_MARKS)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole, limit=1 << 20):
            buf, at = text_bytes(batch.column("text"))
            text, h, _, _ = anchors(buf, at)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64)))], ["k1", "k2", "hashes"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the strings under repeated anchors; the bytes only where this task hasn't given them yet."""
    seen: dict[tuple[int, int], int] = {}
    for whole in batches:
        for batch in parts(whole, limit=1 << 20):
            buf, at = text_bytes(batch.column("text"))
            text, h, start, n = anchors(buf, at)
            h = h.view(np.int64)
            known, pieces = batch.column("hashes"), batch.column("pieces")
            koff, kflat, pflat = known.offsets.to_numpy(), known.flatten().to_numpy(), pieces.flatten().to_numpy()
            koff = koff - koff[0]
            rows = np.repeat(np.arange(batch.num_rows), np.diff(koff))
            both = np.zeros(len(rows), [("r", np.int64), ("h", np.int64)])
            both["r"], both["h"] = rows, kflat
            by = np.argsort(both, order=("r", "h"))
            both, pflat = both[by], pflat[by]
            ask = np.zeros(len(h), both.dtype)
            ask["r"], ask["h"] = text, h
            place = np.minimum(np.searchsorted(both, ask), max(len(both) - 1, 0))
            hit = both[place] == ask if len(both) else np.zeros(len(h), bool)
            text, h, start, n, many = text[hit], h[hit], start[hit], n[hit], pflat[place[hit]] if len(both) else np.zeros(0, np.int64)
            stop = start + n + LENGTH - 1
            raw = buf.tobytes()
            d = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.uint64).view(np.int64)
            ctx: list[bytes | None] = []
            again = np.zeros(len(h), bool)
            for k, (x, y, a, b) in enumerate(zip(h.tolist(), d.tolist(), start.tolist(), stop.tolist(), strict=True)):
                times = seen.get((x, y), 0)
                ctx.append(None if times else raw[a:b])
                again[k] = times == 1
                seen[x, y] = times + 1
            if len(seen) > 500_000:
                seen.clear()
            piece = (d.view(np.uint64) % np.maximum(many, 1).astype(np.uint64)).astype(np.int32)
            cols = [batch.column("k1").take(pa.array(text)), batch.column("k2").take(pa.array(text)), pa.array(start - at[text]), pa.array(h), pa.array(d), pa.array(piece), pa.array(many.astype(np.int32)), pa.array(again), pa.array(ctx, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "pos", "hash", "d", "piece", "pieces", "again", "ctx"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated(docs: DataFrame) -> DataFrame:
    """(k1, k2, spans): for each document with repeated strings, the byte ranges that they cover; ranges may overlap.

    1. Anchors. A string that occurs twice has an anchor that occurs twice, so only strings under repeated anchors go on. They
       are few where few texts repeat, and none that repeats is left out.
    2. Shards by anchor, not by document: occurrences of a string meet in one shard, in contexts of up to 336 bytes. Equal
       contexts go once. Each shard is suffix-sorted and marks strings with a common prefix of LENGTH with a neighbour.
    3. An anchor with more than PIECE occurrences is dealt to several shards. What these found once is searched for in the
       others' sorted fingerprints (128 bits), dealt by fingerprint.

    Contexts count as equal if their anchor's hash and a 64-bit hash of all their bytes agree, strings of two shards if 128-bit hashes
    of their bytes do. Neither is a sum of powers, so no regular text makes them agree. Bytes aren't compared again, as a context's
    bytes are sent once. Within a shard bytes decide.
    """
    rows = docs.select(*row_key(), "text")
    found = written(rows.mapInArrow(_anchored, "k1 long, k2 long, hashes array<long>"), "anchors")
    one = found.select("k1", "k2", F.explode("hashes").alias("hash"))
    often = written(one.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")), "repeated")
    total = often.agg(F.sum("n")).first()[0] or 0
    shards = max(1, int(total * (LENGTH + GRAM) // SHARD))
    per_doc = one.distinct().join(often.select("hash", "pieces"), "hash").groupBy("k1", "k2").agg(F.collect_list(F.struct("hash", "pieces")).alias("x")).select("k1", "k2", F.col("x.hash").alias("hashes"), F.col("x.pieces").alias("pieces"))
    place = written(rows.join(per_doc, ["k1", "k2"]).mapInArrow(_contexts, "k1 long, k2 long, pos long, hash long, d long, piece int, pieces int, again boolean, ctx binary"), "contexts")
    asked = place.filter("ctx is not null or again").withColumn("shard", F.pmod(F.xxhash64("hash", "piece"), F.lit(shards)))
    kind = "hash long, d long, start int, stop int, fp1 long, fp2 long, piece int, pieces int"
    marks = written(asked.groupBy("shard").applyInArrow(_shard, kind), "marks")
    across = marks.filter("stop < 0").withColumn("range", F.pmod(F.col("fp1"), F.lit(shards))).groupBy("range").applyInArrow(_merge, kind)
    runs = marks.filter("stop >= 0").union(across).groupBy("hash", "d").agg(F.max("pieces").alias("pieces"), F.collect_list(F.struct("start", "stop")).alias("runs"))
    # places of a common anchor are dealt out by document, and its runs go to each share
    runs = runs.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    place = place.select("k1", "k2", "pos", "hash", "d", F.pmod(F.xxhash64("k1", "k2"), F.col("pieces")).cast("int").alias("share"))
    span = F.explode(F.transform("runs", lambda x: F.struct((F.col("pos") + x["start"]).alias("start"), (F.col("pos") + x["stop"]).alias("stop"))))
    return place.join(runs, ["hash", "d", "share"]).select("k1", "k2", span.alias("span")).groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))


def _with_spans(docs: DataFrame, carry: list[str]) -> DataFrame:
    row = docs.select(F.struct(*carry).alias("row"), *row_key(), F.coalesce("text", F.lit("")).alias("text"))
    return row.join(repeated(docs), ["k1", "k2"], "left").select("row", "text", F.col("spans.start").alias("start"), F.col("spans.stop").alias("stop"))


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]], bytes]]:
    for text, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "stop")), strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        spans = merged(list(zip(a, b, strict=True))) if a else []
        out, at = [], 0
        for x, y in spans:
            out.append(raw[at:x])
            at = y
        yield raw, spans, b"".join([*out, raw[at:]])


def measured(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop in bytes).

    Null text counts as empty and removes nothing. Repeated rows are documents of their own, so their strings occur elsewhere
    and go. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                got = [(len(raw), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": x, "stop": y} for x, y in spans]) for raw, spans, kept in _kept(batch)]
                n, gone, k, sha, spans = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("row").field("doc_id"), pa.array(n), pa.array(gone), pa.array(k), pa.array(sha), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return _with_spans(docs, ["doc_id"]).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents")).drop("spans")
