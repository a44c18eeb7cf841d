"""Near duplicates on word shingles by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.base import row_key, table, written
from vicinal.llm.components import components
from vicinal.llm.flat import list_column, mix64, numbers, parts, shingles, text_bytes

#: Shingles of five words; documents with 100 * intersection >= 75 * union are linked.
WIDTH, PERCENT = 5, 75
#: 32 bands of 4 minima: a pair at the threshold shares no band with probability (1 - 0.75 ** 4) ** 32, 5 in a million.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Low bits kept of each minimum; a pair whose estimate is MARGIN (5 standard errors) below the threshold isn't verified.
BITS, MARGIN = 4, 0.2
#: Rounds against a bucket's leader. Pairs that are left in a bucket of up to SMALL members are candidates one by one; larger
#: buckets form families, whose pairs are compared in blocks of about BLOCK members and SHINGLES shingles.
STARS, SMALL, BLOCK, SHINGLES = 2, 64, 512, 500_000

_FACTOR, _TERM = numbers(MINIMA, 21) | np.uint64(1), numbers(MINIMA, 22)


def minima(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, MINIMA): the least value of each hash function over a document's shingles; no document may be empty."""
    out = np.empty((len(at) - 1, MINIMA), np.uint64)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat(g * _FACTOR[k] + _TERM[k], at[:-1])
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS of each (mixed) minimum as bit planes, MINIMA bits each, in 64-bit words: (documents, BITS * MINIMA / 64)."""
    low = mix64(m)
    planes = [np.packbits(((low >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), axis=1) for j in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def banded(m: np.ndarray) -> np.ndarray:
    """(documents, BANDS): a hash of each band's whole minima."""
    m = m.reshape(len(m), BANDS, ROWS)
    h = np.broadcast_to(numbers(BANDS, 23), m.shape[:2]).copy()
    for r in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return h.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole):
            g, at = shingles(*text_bytes(batch.column("text")), WIDTH)
            n = np.diff(at)
            some = n > 0
            d = np.zeros((len(n), 2), np.int64)
            bands, sig = np.zeros((len(n), BANDS), np.int64), np.zeros((len(n), BITS * MINIMA // 64), np.int64)
            if some.any():
                cut = np.append(at[:-1][some], at[-1])
                m = minima(g, cut)
                bands[some], sig[some] = banded(m), packed(m)
                for j, salt in enumerate(numbers(2, 24)):
                    d[some, j] = np.add.reduceat(mix64(g ^ salt), cut[:-1]).view(np.int64)
            fixed = lambda x: list_column(x.reshape(-1), np.arange(len(x) + 1) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(n.astype(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), fixed(bands), fixed(sig)], ["doc_id", "k1", "k2", "n", "d1", "d2", "bands", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole):
            g, at = shingles(*text_bytes(batch.column("text")), WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), list_column(g, at)], ["k1", "k2", "set"])


def estimate(a: str | Column, b: str | Column) -> Column:
    """Similarity from two packed signatures: the share of equal minima, less what chance makes of BITS bits."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    words = MINIMA // 64
    other = None
    for w in range(words):
        differ = None
        for j in range(BITS):
            x = a[j * words + w].bitwiseXOR(b[j * words + w])
            differ = x if differ is None else differ.bitwiseOR(x)
        other = F.bit_count(differ) if other is None else other + F.bit_count(differ)
    chance = 0.5**BITS
    return (1 - other / MINIMA - chance) / (1 - chance)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _near(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right): is the estimate within MARGIN of the threshold, or above?"""
    most = MINIMA * (1 - ((PERCENT / 100 - MARGIN) * (1 - 0.5**BITS) + 0.5**BITS))
    out = np.empty((len(left), len(right)), bool)
    for k, x in enumerate(left):
        out[k] = np.bitwise_count(np.bitwise_or.reduce(sig[right] ^ sig[x], axis=1)).sum(axis=1) <= most
    return out


def _signatures(members: pa.Table) -> np.ndarray:
    return members.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(members), BITS, MINIMA // 64)


def _bucket(members: pa.Table) -> pa.Table:
    """The pairs of a small bucket that are in different components and whose estimate isn't too low."""
    ids, comp = members.column("cid").to_numpy(), members.column("comp").to_numpy()
    every = np.arange(len(ids))
    i, j = np.nonzero(_near(_signatures(members), every, every) & (comp[:, None] < comp[None, :]))
    return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}, schema=_LINK)


def _family(key: tuple, members: pa.Table) -> pa.Table:
    """Links between two blocks of a family, verified on whole sets: as many as join components, no more.

    Intersections of all pairs at once are products of 0/1 matrices over the shingles that both sides have.
    """
    same = key[1].as_py() == key[2].as_py()
    side, ids, comp = (members.column(c).to_numpy() for c in ("side", "cid", "comp"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
    near = _near(_signatures(members), left, right) & (comp[left][:, None] != comp[right][None, :])
    lists = members.column("set").combine_chunks()
    cut, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    size = np.diff(cut)
    of = np.repeat(np.arange(len(ids)), size)
    l, r = near.any(1), near.any(0)
    left, right, near = left[l], right[r], near[l][:, r]
    if not near.any():
        return _LINK.empty_table()
    row = np.full((2, len(ids)), -1)
    row[0, left], row[1, right] = np.arange(len(left)), np.arange(len(right))
    shared = np.intersect1d(flat[row[0, of] >= 0], flat[row[1, of] >= 0])
    at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
    there = (shared[at] == flat) if len(shared) else np.zeros(len(flat), bool)
    both = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, len(shared), 4096):
        here = there & (at >= c) & (at < c + 4096)
        m = [np.zeros((n, 4096), np.float32) for n in (len(left), len(right))]
        for k in (0, 1):
            some = here & (row[k, of] >= 0)
            m[k][row[k, of[some]], at[some] - c] = 1
        both += m[0] @ m[1].T
    link = near & (100 * both >= PERCENT * (size[left][:, None] + size[right][None, :] - both))
    i, j = np.nonzero(link)
    _, first = np.unique(np.column_stack([comp[left[i]], comp[right[j]]]), axis=0, return_index=True)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for k in first.tolist():
        a, b = root(int(comp[left[i[k]]])), root(int(comp[right[j[k]]]))
        if a != b:
            parent[b] = a
            out.append(sorted((int(ids[left[i[k]]]), int(ids[right[j[k]]]))))
    return pa.table({"a": [x[0] for x in out], "b": [x[1] for x in out]}, schema=_LINK)


def linked(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, k1, k2, n_shingles, component_id, kept.

    1. Signatures. Documents with equal sets are one class from here on, so thousands of exact copies are one member.
    2. Buckets: classes that share a band. Rounds compare a bucket's members with one leader; buckets whose members are
       all in one component are done. Of what is left, small buckets give their pairs in different components whose signatures
       are near. Large buckets with common members are one family, each of whose pairs is compared once, in blocks.
    3. Every candidate's sets are intersected before it counts as a link; components follow.

    Null and empty texts are linked with nothing; repeated rows share a class; null ids never become a component's id unless
    alone. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text")
    signed = written(rows.mapInArrow(_sign, "doc_id long, k1 long, k2 long, n long, d1 long, d2 long, bands array<long>, sig array<long>"), "signed")
    lead = signed.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("k1", "k2")).alias("k"), F.min("doc_id").alias("least"))
    lead = lead.select("d1", "d2", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"), "least")
    classes = signed.filter("n > 0").join(lead, ["d1", "d2", "k1", "k2"]).dropDuplicates(["d1", "d2"])
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "d1", "d2", "k1", "k2", "n", "least", "bands", "sig"), "classes")

    member = classes.select("cid", F.explode("bands").alias("bucket"))
    many = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    member = written(member.join(many, "bucket"), "members")
    asked = classes.select("cid", "k1", "k2").join(member.select("cid").distinct(), "cid", "left_semi")
    sets = written(rows.select("k1", "k2", "text").join(asked.select("k1", "k2"), ["k1", "k2"], "left_semi").mapInArrow(_sets, "k1 long, k2 long, set array<long>").dropDuplicates(["k1", "k2"]).join(asked, ["k1", "k2"]).select("cid", "set"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of (a, b) whose sets are similar enough."""
        of = lambda df, *c: [df.select(F.col("cid").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in c)) for x in "ab"]
        sig_a, sig_b = of(classes.select("cid", "sig", "n"), "sig", "n")
        close = pairs.distinct().join(sig_a, "a").join(sig_b, "b").filter((estimate("sig_a", "sig_b") >= PERCENT / 100 - MARGIN) & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))).select("a", "b", "n_a", "n_b")
        set_a, set_b = of(sets, "set")
        both = F.size(F.array_intersect("set_a", "set_b"))
        return close.join(set_a, "a").join(set_b, "b").filter(100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")

    links, comp = None, classes.select("cid", F.col("cid").alias("comp")).limit(0)
    for k in range(STARS):
        # the leader is another member each time
        rank = F.struct((F.xxhash64("cid", F.lit(k)) if k else F.col("cid")).alias("order"), F.col("cid"))
        first = member.groupBy("bucket").agg(F.min(rank)["cid"].alias("b"))
        pairs = member.join(first, "bucket").filter("cid <> b").select(F.least("cid", "b").alias("a"), F.greatest("cid", "b").alias("b"))
        if k:
            own = comp.select(F.col("cid").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("cid").alias("b"), F.col("comp").alias("cb"))
            pairs = pairs.distinct().join(own[0], "a", "left").join(own[1], "b", "left").filter("ca is null or cb is null or ca <> cb").select("a", "b")
        found = written(verified(pairs), "links")
        links = found if links is None else written(links.union(found), "links")
        comp = written(components(links).withColumnRenamed("id", "cid"), "comp")
        # buckets with members of two components or more
        named = member.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        open_ = named.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).filter("x <> y").select("bucket", "size")
        left = written(named.join(open_, "bucket").select("bucket", "cid", "size", "comp"), "members")
        member = left.select("cid", "bucket")

    few, lot = left.filter(F.col("size") <= SMALL), left.filter(F.col("size") > SMALL)
    rest = few.join(classes.select("cid", "sig"), "cid").select("bucket", "cid", "comp", "sig").groupBy("bucket").applyInArrow(_bucket, "a long, b long")
    found = links.union(verified(rest))

    to = lot.groupBy("bucket").agg(F.min("cid").alias("b"))
    family = components(lot.select("bucket", F.col("cid").alias("a")).join(to, "bucket").select("a", "b")).select(F.col("id").alias("cid"), F.col("comp").alias("family"))
    mate = family.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).join(classes.select("cid", "sig", "n"), "cid")
    size = mate.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    mate = mate.join(size, "family").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).join(sets, "cid")
    dealt = mate.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "comp", "sig", "set")
    found = found.union(dealt.groupBy("family", "i", "j").applyInArrow(_family, "a long, b long"))
    comp = components(found).withColumnRenamed("id", "cid")

    group = classes.select("cid", "d1", "d2", "least").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = group.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = group.join(least, "comp").select("d1", "d2", "component_id")
    out = signed.select("doc_id", "k1", "k2", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def unique(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the document with the least id; columns as they are. Of rows equal in id and text, the
    one whose columns have the least hash, so reruns agree."""
    said = linked(docs).filter("kept").select("k1", "k2").dropDuplicates(["k1", "k2"])
    order = F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t and t != "variant"))
    row = docs.select(F.struct(*docs.columns).alias("row"), order.alias("order"), *row_key())
    return row.join(said, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by("row", "order").alias("row")).select("row.*")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).drop("k1", "k2")
