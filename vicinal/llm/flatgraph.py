"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.arrays import matrix
from vicinal.llm.base import dropped, table, written
from vicinal.llm.components import components

#: Vectors of this cosine at least are linked.
COSINE = 0.95
#: Centroids are fitted on this many vectors at most, those of least hash; one for SHARD vectors, a quarter of the sample at most.
SAMPLE, SHARD = 65_536, 800
#: Shards that a vector belongs to at first; the most that a shard's part may hold.
OVERLAP, PART = 3, 8_000
#: Neighbours kept of each vector, of how many candidates, and the slack of pruning; far members that it is joined with besides,
#: as tight clusters would be islands.
DEGREE, CANDIDATES, ALPHA, FAR = 16, 48, 1.2, 8
#: Width of the greedy search, and medoids that it starts from.
BEAM, MEDOIDS = 24, 64
#: The audit compares classes with a vec_id divisible by ASKED with all others. Under RECALL the overlap is doubled, up to MOST; if
#: that doesn't do, all pairs are compared, BLOCK vectors with BLOCK vectors.
ASKED, RECALL, MOST, BLOCK = 50, 0.99, 12, 4_096


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, exactly, so that the largest component is near 1 and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def centroids(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means from the first k of the sample."""
    c = x[:k].copy()
    for _ in range(rounds if k > 1 else 0):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        some = np.einsum("ij,ij->i", total, total) > 1e-12
        c[some] = unit(total[some])
    return c


def robust_prune(x: np.ndarray, cand: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each row of x the candidates (indices into x, by falling similarity `near`) that aren't covered by a nearer one; -1 for none.

    The nearest candidate is kept; those that it is ALPHA times nearer to than the vector itself go; and so on, DEGREE times.
    """
    n, m = cand.shape
    out = np.full((n, DEGREE), -1)
    far = np.sqrt(np.maximum(2 - 2 * near, 0))
    for b in range(0, n, 256):
        v = x[cand[b : b + 256]]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("nid,njd->nij", v, v, optimize=True), 0))
        alive = cand[b : b + 256] >= 0
        rows = np.arange(len(v))
        for r in range(min(DEGREE, m)):
            pick = alive.argmax(1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[b : b + 256][some, r] = cand[b : b + 256][some, pick[some]]
            alive &= ~((ALPHA * between[rows, pick] <= far[b : b + 256]) & some[:, None])
            alive[rows, pick] = False
    return out


def build(x: np.ndarray) -> np.ndarray:
    """Adjacency of a shard's part: (n, DEGREE + FAR) indices, -1 for none."""
    n = len(x)
    m = min(CANDIDATES, n - 1)
    if m < 1:
        return np.full((n, DEGREE + FAR), -1)
    cand, near = np.empty((n, m), np.int64), np.empty((n, m))
    for b in range(0, n, 512):
        s = x[b : b + 512] @ x.T
        rows = np.arange(len(s))
        s[rows, b + rows] = -np.inf
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        val = s[rows[:, None], top]
        by = np.argsort(-val, axis=1, kind="stable")
        cand[b : b + 512], near[b : b + 512] = top[rows[:, None], by], val[rows[:, None], by]
    far = np.random.default_rng(n).integers(0, n, (n, FAR))
    return np.concatenate([robust_prune(x, cand, near), np.where(far == np.arange(n)[:, None], -1, far)], axis=1)


def medoids(x: np.ndarray, k: int = MEDOIDS, rounds: int = 2) -> np.ndarray:
    """Members that k clusters of x are nearest around: seeds far from each other, then the member nearest to each cluster's mean."""
    out = [int((x @ x.mean(0)).argmax())]
    most = x @ x[out[0]]
    while len(out) < min(k, len(x)):
        out.append(int(most.argmin()))
        most = np.maximum(most, x @ x[out[-1]])
    now = np.unique(out)
    for _ in range(rounds):
        of = (x @ x[now].T).argmax(1)
        total = np.zeros((len(now), x.shape[1]))
        np.add.at(total, of, x)
        near = np.einsum("ij,ij->i", x, total[of])
        by = np.lexsort((-near, of))
        now = np.unique(by[np.concatenate([[True], of[by][1:] != of[by][:-1]])])
    return now


def search(x: np.ndarray, near: np.ndarray, start: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) of similarity `least` at least that a greedy search finds.

    All queries go together: each expands its nearest open node of the BEAM best; then the range grows: every member found
    within it is expanded too, until nothing new is within.
    """
    n, k = len(x), len(q)
    seen = np.zeros((k, n), bool)
    rows = np.arange(k)
    ids = np.full((k, BEAM), -1)
    sim = np.full((k, BEAM), -np.inf)
    open_ = np.zeros((k, BEAM), bool)
    to = q @ x[start].T
    by = np.argsort(-to, axis=1, kind="stable")[:, :BEAM]
    w = by.shape[1]
    ids[:, :w], sim[:, :w], open_[:, :w] = start[by], to[rows[:, None], by], True
    seen[:, start] = True
    r, m = np.nonzero(to >= least)
    hit = [np.column_stack([r, start[m]])]
    todo: list[np.ndarray] = list(hit)

    def visit(r: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New neighbours of node of[i] for query r[i], as (query, node, similarity)."""
        nb = near[of]
        at, j = np.nonzero(nb >= 0)
        rr, nn = r[at], nb[at, j]
        fresh = ~seen[rr, nn]
        key = np.unique(rr[fresh] * n + nn[fresh])
        rr, nn = key // n, key % n
        seen[rr, nn] = True
        s = np.einsum("ij,ij->i", q[rr], x[nn])
        within = s >= least
        if within.any():
            found = np.column_stack([rr[within], nn[within]])
            hit.append(found)
            todo.append(found)
        return rr, nn, s

    while open_.any():
        best = np.where(open_, sim, -np.inf).argmax(1)
        act = rows[open_[rows, best]]
        open_[act, best[act]] = False
        rr, nn, s = visit(act, ids[act, best[act]])
        if len(rr):
            first = np.searchsorted(rr, rows)
            width = np.diff(np.append(first, len(rr)))
            most = width.max()
            pad_i, pad_s = np.full((k, most), -1), np.full((k, most), -np.inf)
            pos = np.arange(len(rr)) - first[rr]
            pad_i[rr, pos], pad_s[rr, pos] = nn, s
            all_s = np.concatenate([sim, pad_s], 1)
            by = np.argsort(-all_s, axis=1, kind="stable")[:, :BEAM]
            ids = np.concatenate([ids, pad_i], 1)[rows[:, None], by]
            sim = all_s[rows[:, None], by]
            open_ = np.concatenate([open_, pad_i >= 0], 1)[rows[:, None], by] & (sim > -np.inf)
    while todo:
        now = np.concatenate(todo)
        todo.clear()
        for b in range(0, len(now), 4096):
            visit(now[b : b + 4096, 0], now[b : b + 4096, 1])
    found = np.concatenate(hit)
    return found[:, 0], found[:, 1]


_ROWS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
ROWS = "a long, b long, n long"


class _Tally:
    """What a group of queries and members gives: how many vectors each query is linked with, and links that join components, no
    more of them than there are members and queries. No list of all pairs is kept or sent."""

    def __init__(self, ask: np.ndarray, own: np.ndarray, raw_ask: np.ndarray, raw_own: np.ndarray, size: np.ndarray, shards: tuple[np.ndarray, np.ndarray, int] | None = None) -> None:
        """shards: those of each query, those of each member, and the one at hand; a pair of several shards counts in the least."""
        self.ask, self.own, self.size, self.shards = ask, own, size, shards
        self.x, self.y = scaled(raw_ask), scaled(raw_own)
        self.nx, self.ny = np.sqrt(np.einsum("ij,ij->i", self.x, self.x)), np.sqrt(np.einsum("ij,ij->i", self.y, self.y))
        self.ids = np.unique(np.concatenate([ask, own]))
        self.at_ask, self.at_own = np.searchsorted(self.ids, ask), np.searchsorted(self.ids, own)
        self.label = np.arange(len(self.ids))
        self.n = np.zeros(len(ask), np.int64)
        self.links: list[tuple[int, int]] = []

    def add(self, r: np.ndarray, m: np.ndarray) -> None:
        """Pairs (query, member) that may be links, each at most once; the cosine itself decides, in double precision."""
        true = np.zeros(len(r), bool)
        for k in range(0, len(r), 65_536):
            i, j = r[k : k + 65_536], m[k : k + 65_536]
            true[k : k + 65_536] = np.einsum("ij,ij->i", self.x[i], self.y[j]) / (self.nx[i] * self.ny[j]) >= COSINE
        true &= self.ask[r] != self.own[m]
        r, m = r[true], m[true]
        if not len(r):
            return
        here = np.ones(len(r), bool)
        if self.shards:
            of_ask, of_own, at = self.shards
            for k in range(0, len(r), 65_536):
                i, j = of_ask[r[k : k + 65_536]], of_own[m[k : k + 65_536]]
                both = (i[:, :, None] == j[:, None, :]).any(2)
                here[k : k + 65_536] = np.where(both, i, np.iinfo(np.int64).max).min(1) == at
        self.n += np.bincount(r[here], self.size[m[here]], len(self.ask)).astype(np.int64)
        by = np.argsort(r, kind="stable")
        r, m = r[by], m[by]
        head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        for b, e in zip(head.tolist(), np.append(head[1:], len(r)).tolist(), strict=True):
            me = self.at_ask[r[b]]
            labels, first = np.unique(self.label[self.at_own[m[b:e]]], return_index=True)
            other = labels != self.label[me]
            if other.any():
                self.links += [(int(self.ids[me]), int(self.own[m[b + f]])) for f in first[other].tolist()]
                self.label[np.isin(self.label, labels[other])] = self.label[me]

    def rows(self) -> pa.Table:
        some = np.flatnonzero(self.n)
        a = pa.array(np.concatenate([np.array([x for x, _ in self.links], np.int64), self.ask[some]]))
        b = pa.array([y for _, y in self.links] + [None] * len(some), pa.int64())
        n = pa.array([None] * len(self.links) + self.n[some].tolist(), pa.int64())
        return pa.table([a, b, n], schema=_ROWS)


def _adjacent(members: pa.Table) -> pa.Table:
    ids = members.column("cid").to_numpy()
    near = build(unit(matrix(members.column("x"))))
    at, j = np.nonzero(near >= 0)
    cut = np.searchsorted(at, np.arange(len(ids) + 1)).astype(np.int32)
    return pa.table({"cid": members.column("cid"), "near": pa.ListArray.from_arrays(pa.array(cut), pa.array(ids[near[at, j]]))})


def _sides(members: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members (side 0, by id) and queries (side 1) as places, their ids and vectors."""
    side, ids = members.column("side").to_numpy(), members.column("cid").to_numpy()
    own, ask = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return own[np.argsort(ids[own])], ask, ids, matrix(members.column("x"))


def _found(members: pa.Table) -> pa.Table:
    """One part of a shard and a block of the shard's members as queries: what the graph search finds."""
    own, ask, ids, raw = _sides(members)
    if not len(own) or not len(ask):
        return _ROWS.empty_table()
    lists = members.column("near").combine_chunks()
    flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())[own]
    begin = lists.offsets.to_numpy()[own] - lists.offsets.to_numpy()[0]
    width = max(1, int(size.max()))
    near = np.full((len(own), width), -1)
    for w in range(width):
        some = size > w
        got = flat[begin[some] + w]
        at = np.minimum(np.searchsorted(ids[own], got), len(own) - 1)
        near[some, w] = np.where(ids[own][at] == got, at, -1)
    x = unit(raw)
    y = x[own]
    start = medoids(y)
    shards = matrix(members.column("shards")).astype(np.int64)
    tally = _Tally(ids[ask], ids[own], raw[ask], raw[own], members.column("size").to_numpy()[own], (shards[ask], shards[own], members.column("shard")[0].as_py()))
    for k in range(0, len(ask), 256):
        r, m = search(y, near, start, x[ask[k : k + 256]], COSINE - 1e-6)
        tally.add(k + r, m)
    return tally.rows()


def _compared(members: pa.Table) -> pa.Table:
    """A block of queries and a block of members of one length: all pairs."""
    own, ask, ids, raw = _sides(members)
    if not len(own) or not len(ask):
        return _ROWS.empty_table()
    x = unit(raw)
    tally = _Tally(ids[ask], ids[own], raw[ask], raw[own], members.column("size").to_numpy()[own])
    for k in range(0, len(ask), 256):
        r, m = np.nonzero(x[ask[k : k + 256]] @ x[own].T >= COSINE - 1e-6)
        tally.add(k + r, m)
    return tally.rows()


def assigned(classes: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """(cid, x, size, shard, shards): each class in the shards of its `overlap` nearest centroids."""
    m = min(overlap, len(c))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 512):
                part = batch.slice(b, 512)
                s = unit(matrix(part.column("x"))) @ c.T
                top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(m), (len(s), 1))
                yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("x"), part.column("size"), pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, m, dtype=np.int32)), pa.array(top.reshape(-1).astype(np.int32)))], ["cid", "x", "size", "shards"])

    got = classes.select("cid", "x", "size").mapInArrow(assign, "cid long, x array<double>, size long, shards array<int>")
    return got.withColumn("shard", F.explode("shards"))


def links(member: DataFrame) -> DataFrame:
    """(a, b, n) of members (cid, x, size, shard, shards): links (a, b) that join components, and (a, null, n) with the number of
    vectors that class a is linked with. Each class asks in each of its shards; a pair that meets in several counts in the least of
    them, where each of the two asks for the other, so it counts for both or for neither.

    Graphs are built on each shard's parts, and a class's lists of all its shards are united. A shard of over PART members is cut
    into parts, and its queries into blocks; each block asks each part.
    """
    member = start = written(member, "shards")
    size = member.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).withColumn("blocks", F.col("parts"))
    member = member.join(size, "shard").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    graph = member.groupBy("shard", "part").applyInArrow(_adjacent, "cid long, near array<long>").select("cid", F.explode("near").alias("to"))
    union = written(graph.groupBy("cid").agg(F.collect_set("to").alias("near")), "graph")
    none = F.expr("array()").cast("array<bigint>")
    own = member.join(union, "cid", "left").withColumn("near", F.coalesce("near", none)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    ask = member.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1)).withColumn("near", none)
    cols = ["shard", "part", "block", "side", "cid", "x", "size", "shards", "near"]
    out = written(own.select(*cols).unionByName(ask.select(*cols)).groupBy("shard", "part", "block").applyInArrow(_found, ROWS), "found")
    dropped(start, union)
    return out


def exact(classes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The same rows from all pairs of equal length, or from all pairs with a class of `asked`, block by block."""
    size = classes.groupBy("d").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("parts"))
    ask = (classes if asked is None else asked).select("d", "cid", "x", "size")
    blocks = ask.groupBy("d").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    both = size.join(blocks, "d")
    deal = lambda df, mine, n, other, m, side, salt: df.join(both, "d").withColumn(mine, F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).withColumn("side", F.lit(side)).select("d", "part", "block", "side", "cid", "x", "size")
    left = deal(classes.select("d", "cid", "x", "size"), "part", "parts", "block", "blocks", 0, 1)
    right = deal(ask, "block", "blocks", "part", "parts", 1, 2)
    return left.unionByName(right).groupBy("d", "part", "block").applyInArrow(_compared, ROWS)


def audit(classes: DataFrame, found: DataFrame) -> tuple[int, int]:
    """How many vectors the asked classes are linked with by brute force, and with how many the search linked them."""
    asked = classes.filter("asked")
    true = exact(classes, asked).filter("n is not null").groupBy("a").agg(F.sum("n").alias("true"))
    got = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("got"))
    row = true.join(got, "a", "left").agg(F.sum("true").alias("n"), F.sum("got").alias("hit")).first()
    return row.n or 0, row.hit or 0


def searched(classes: DataFrame, overlap: int) -> DataFrame:
    """links of all classes: lengths with few classes are a shard each, the others have centroids of their own length."""
    lengths = classes.groupBy("d").agg(F.count("*").alias("n"))
    many = [(r.d, r.n) for r in lengths.filter(F.col("n") > 2 * SHARD).orderBy("d").collect()]  # an element for 1,600 vectors at most
    few = classes.join(lengths.filter(F.col("n") <= 2 * SHARD).select("d"), "d", "left_semi")
    out = links(few.select("cid", "x", "size", F.col("d").alias("shard"), F.array("d").alias("shards")))
    for d, n in many:
        own = classes.filter(F.col("d") == d)
        sample = unit(matrix(own.select("h1", "h2", "x").orderBy(F.xxhash64("h1"), "h1", "h2").limit(SAMPLE).toArrow().column("x")))
        c = centroids(sample, max(1, min(n // SHARD, len(sample) // 4)))
        out = out.unionByName(links(assigned(own, c, overlap)))
    return out


def linked(vectors: DataFrame) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept, recall.

    Equal vectors are one class from here on. Vectors of one length are linked with each other, never with those of another.
    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, not even their copies; of any other,
    however large or small its numbers, the cosine counts. Repeated ids are rows of their own, each counting the others; a null id
    is linked, but names a component only if no id is in it. No vectors give no rows; labels and extra columns are ignored.

    recall: the audited share of links that the search found, the same in each row (1 where the audit found none to ask for).
    Under RECALL the overlap of shards is doubled; if that doesn't help, all pairs are compared in blocks and nothing is missed.
    """
    x = F.col("embedding").cast("array<double>")
    whole = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(whole, F.transform(x, lambda v: v + F.lit(0.0))).alias("x")).withColumns({"d": F.size("x"), "h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), F.reverse("x"))}), "vectors")
    classes = rows.filter("x is not null").groupBy("d", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.max(F.coalesce(F.pmod("vec_id", F.lit(ASKED)) == 0, F.lit(False))).alias("asked"), F.any_value("x").alias("x"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    overlap = OVERLAP
    while True:
        found = searched(classes, overlap)
        true, hit = audit(classes, found)
        if hit >= RECALL * true:
            break
        if overlap >= MOST:
            found, hit = written(exact(classes), "exact"), true
            break
        overlap *= 2
    # a search may see a link from one end only: links that join components count for both
    two = found.filter("b is not null").select("a", "b")
    two = two.unionByName(two.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    sure = two.join(classes.select(F.col("cid").alias("b"), "size"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("size").alias("sure"))
    comp = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("id", "cid")
    far = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("far")).withColumnRenamed("a", "cid")
    group = classes.select("cid", "d", "h1", "h2", "least", "size").join(far, "cid", "left").join(sure, "cid", "left").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = group.groupBy("comp").agg(F.min("least").alias("component_id"))
    group = group.join(least, "comp").select("d", "h1", "h2", "component_id", (F.col("size") - 1 + F.greatest(F.coalesce("far", F.lit(0)), F.coalesce("sure", F.lit(0)))).alias("n"))
    out = rows.select("vec_id", "d", "h1", "h2", F.col("x").isNotNull().alias("ok")).join(group, ["d", "h1", "h2"], "left")
    own = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("ok"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"), F.lit(hit / true if true else 1.0).alias("recall"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
