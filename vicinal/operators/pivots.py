"""Exact nearest neighbours of large tables: cells around pivots, and only the cells that can hold a neighbour."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.functions.arrays import matrix
from vicinal.session import dropped, written

#: Base vectors for a pivot; pivots, bytes of pivots, and cells (of one pivot and group) at most, so what goes to every task is bounded.
PER, PIVOTS, BYTES, CELLS = 1_000, 2_048, 16 << 20, 1 << 16
#: Share of all pairs beyond which cells aren't worth their messages, and bytes of a block of the base then, at most.
WORTH, LARGE = 0.25, 32 << 20
#: Queries whose bounds are taken at once.
AT_ONCE = 64
KIND = "src long, dst long, dist double, grp string"


def far(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of all rows to all pivots, from plain differences."""
    return np.sqrt(np.stack([np.einsum("ij,ij->i", x - v, x - v) for v in p], 1)) if len(p) else np.zeros((len(x), 0))


@dataclass
class Cells:
    """base: (node, x, grp, cell, block), written, where cell is a number for a pivot and group; the rest, by cell: which pivot, which
    group, how many members, how far the farthest is from the pivot."""

    base: DataFrame
    pivots: np.ndarray
    pivot: np.ndarray
    group: np.ndarray
    groups: list[str]
    size: np.ndarray
    radius: np.ndarray

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and cell the distance to its pivot, and one that no member can be nearer than: members are within the radius,
        and nearer to their own pivot than to the row's."""
        d = far(x, self.pivots)
        at = d[:, self.pivot]
        return at, np.maximum(at - self.radius, (at - d.min(1, keepdims=True)) / 2)


def cells(base: DataFrame, n: int, d: int, block: int) -> Cells:
    """Pivots are base vectors of least hash; a vector belongs to the cell of its nearest pivot, the first of equals."""
    spark = base.sparkSession
    groups = base.select("grp").distinct().count()
    number = max(1, min(PIVOTS, n // PER, BYTES // (8 * max(1, d)), CELLS // max(1, groups)))
    p = matrix(base.select("node", "x").orderBy(F.xxhash64("node"), "node").limit(number).toArrow().column("x"))  # bounded
    shared = spark.sparkContext.broadcast(p)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                dist = far(matrix(part.column("x")), p)
                near = dist.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(dist[np.arange(len(near)), near])], ["node", "x", "grp", "pivot", "far"])

    rows = written(base.select(F.col("node").cast("long").alias("node"), F.col("x").cast("array<double>").alias("x"), "grp").mapInArrow(assign, "node long, x array<double>, grp string, pivot int, far double"), "assigned")
    each = rows.groupBy("grp", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("grp", "pivot").toPandas()  # CELLS at most
    names = sorted(set(each["grp"]))
    place = {g: i for i, g in enumerate(names)}
    number_of = spark.createDataFrame([(g, int(v), i, -(-int(m) // block)) for i, (g, v, m) in enumerate(zip(each["grp"], each["pivot"], each["n"], strict=True))], "grp string, pivot int, cell int, blocks int")
    out = written(rows.join(F.broadcast(number_of), ["grp", "pivot"]).select("node", "x", "grp", "cell", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks"), "cells")
    dropped(rows)
    return Cells(out, p, each["pivot"].to_numpy(np.int64), np.array([place[g] for g in each["grp"]], np.int64), names, each["n"].to_numpy(np.int64), each["radius"].to_numpy(float))


def compared(asked: DataFrame, found: Cells, block: int, pair: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """pair() of each block of a cell with each block of the queries (node, x, cell) that are sent to it."""
    many = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("askers"))
    size = found.base.select("cell", "blocks").distinct()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    most = [c for c in ("most",) if c in asked.columns]
    left = found.base.join(F.broadcast(many), "cell").select("cell", "block", every("askers").alias("asker"), F.lit(0).alias("side"), "node", "x", "grp", *(F.lit(0.0).alias(c) for c in most))
    right = asked.join(F.broadcast(many), "cell").join(F.broadcast(size), "cell").select("cell", every("blocks").alias("block"), F.pmod(F.xxhash64("node"), F.col("askers")).cast("int").alias("asker"), F.lit(1).alias("side"), "node", "x", F.lit("").alias("grp"), *most)
    return left.unionByName(right).groupBy("cell", "block", "asker").applyInArrow(pair, KIND)


def first_asked(queries: DataFrame, found: Cells, k: int) -> DataFrame:
    """(node, x, cell): for each query and group the nearest cell with more than k members."""
    enough = found.size > k

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, AT_ONCE):
                part = b.slice(start, AT_ONCE)
                at, _ = found_.bounds(matrix(part.column("x")))
                rows, to = [], []
                for g in range(len(found_.groups)):
                    some = np.flatnonzero((found_.group == g) & enough)
                    if len(some):
                        rows.append(np.arange(part.num_rows))
                        to.append(some[at[:, some].argmin(1)])
                if rows:
                    yield _rows(part, np.concatenate(rows), np.concatenate(to))

    found_ = _light(found)
    return queries.mapInArrow(send, "node long, x array<double>, cell int")


def then_asked(queries: DataFrame, found: Cells, k: int, first: DataFrame, count: bool = False) -> DataFrame:
    """(node, x, cell): the other cells that can hold one of a query's k nearest, by the k-th distance that the first pass found in the
    group; without one, all cells of the group. count: only (n), numbers of pairs of a query and a member that this makes."""
    done = first.groupBy("dst", "grp").agg(F.count("*").alias("n"), F.max("dist").alias("d"))
    bound = done.groupBy(F.col("dst").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("grp", F.struct("n", "d")))).alias("bound"))  # a row a group

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {g: i for i, g in enumerate(found_.groups)}
        enough = found_.size > k
        for b in batches:
            for start in range(0, b.num_rows, AT_ONCE):
                part = b.slice(start, AT_ONCE)
                at, least = found_.bounds(matrix(part.column("x")))
                most = np.full((part.num_rows, len(place)), np.inf)
                for i, m in enumerate(part.column("bound").to_pylist()):
                    for g, v in m or ():
                        if v["n"] >= k:
                            most[i, place[g]] = v["d"]
                most = most[:, found_.group]
                on = least <= most * (1 + 1e-9) + 1e-9
                for g in range(len(place)):  # the first pass asked there
                    some = np.flatnonzero((found_.group == g) & enough)
                    if len(some):
                        on[np.arange(part.num_rows), some[at[:, some].argmin(1)]] = False
                rows, to = np.nonzero(on)
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([int(found_.size[to].sum())])], ["n"])
                elif len(rows):
                    yield _rows(part, rows, to)

    found_ = _light(found)
    return queries.join(bound, "node", "left").mapInArrow(send, "n long" if count else "node long, x array<double>, cell int")


def all_compared(queries: DataFrame, found: Cells, n: int, d: int, block: int, k: int, first: DataFrame, pair: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """pair() of each block of the base with each block of the queries. What moves are vectors once for each block of the other side, not
    for each cell; with one group, queries take along the distance that the first pass found."""
    blocks = max(1, -(-n // max(1, LARGE // (8 * max(1, d)))))
    base = found.base.select("node", "x", "grp", F.lit(0).alias("cell"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), F.lit(blocks).alias("blocks"))
    ask = queries.withColumn("cell", F.lit(0))
    if len(found.groups) == 1:
        done = first.groupBy(F.col("dst").alias("node")).agg(F.when(F.count("*") >= k, F.max("dist")).alias("most"))
        ask = ask.join(done, "node", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    return compared(ask, Cells(base, found.pivots, found.pivot, found.group, found.groups, found.size, found.radius), block, pair)


def _light(found: Cells) -> Cells:
    return Cells(None, found.pivots, found.pivot, found.group, found.groups, found.size, found.radius)


def _rows(part: pa.RecordBatch, rows: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([part.column("node").take(at), part.column("x").take(at), pa.array(to.astype(np.int32))], ["node", "x", "cell"])


def nearest_in_cells(queries: DataFrame, base: DataFrame, n: int, d: int, k: int, block: int, pair: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """(src, dst, dist, grp): candidates that hold each query's k nearest base rows of each group.

    A first pass asks the nearest cell that has enough members and so finds, for each group, a distance within which k are; a second
    asks the cells that the triangle inequality doesn't rule out. Large cells and many queries to one cell are dealt into blocks. Where
    these hold more than WORTH of all pairs, which is counted first, all blocks are compared instead.
    """
    if not n:
        return queries.sparkSession.createDataFrame([], KIND)
    found = cells(base, n, d, block)
    ask = written(queries.select(F.col("node").cast("long").alias("node"), F.col("x").cast("array<double>").alias("x")), "queries")
    one = written(first_asked(ask, found, k), "asked")
    first = written(compared(one, found, block, pair), "first")
    # k of each group, over the blocks of a cell
    bound = first.withColumn("rank", F.row_number().over(W.partitionBy("dst", "grp").orderBy("dist", "src"))).filter(F.col("rank") <= k)
    if (then_asked(ask, found, k, bound, count=True).agg(F.sum("n")).first()[0] or 0) > WORTH * n * ask.count():
        out = written(all_compared(ask, found, n, d, block, k, bound, pair), "candidates")
        dropped(ask, one, first, found.base)
        return out
    two = written(then_asked(ask, found, k, bound), "asked")
    out = written(first.unionByName(compared(two, found, block, pair)), "candidates")
    dropped(ask, one, first, two, found.base)
    return out
