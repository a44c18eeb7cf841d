"""Neighbour graphs in which held-out nodes receive edges from training nodes, and send none.

nodes: (node, x, y, donor, site, part). Edges: (src, dst, dist), at most one for each (src, dst).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vicinal.functions.arrays import matrix
from vicinal.functions.ranks import median
from vicinal.functions.scalars import content_hash
from vicinal.operators.pivots import nearest_in_cells
from vicinal.session import dropped, written

#: Vectors of this many bytes at most go to every task whole; more of them are compared in blocks.
RESIDENT = 64 << 20
#: Vectors in a block.
BLOCK = 20_000
#: Distances in double precision that a task holds at once, whatever the numbers of queries and members.
AT_ONCE = 1 << 21
#: Queries and members of a tile of distances in single precision, which a core's cache holds, and members in a run at most.
ROWS, COLUMNS, RUN = 256, 2048, 16
#: Candidates whose distances are taken from plain differences at once.
PIECE = 1 << 14


def _itself(ids: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) places where both have the same id; ids ascend."""
    lo, hi = np.searchsorted(ids, asks), np.searchsorted(ids, asks, "right")
    some = [np.flatnonzero(lo + t < hi) for t in range(int((hi - lo).max(initial=0)))]
    return (np.concatenate(some), np.concatenate([lo[i] + t for t, i in enumerate(some)])) if some else (lo[:0], lo[:0])


def _close(v: np.ndarray, low: np.ndarray, norm: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int, slack: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(query, member) places of all pairs that may be among a query's k nearest, `own` apart, from products in single precision, a tile at
    a time. None if these are over 8k a query, so single precision doesn't tell members apart.

    The k least of the minima of disjoint runs of members belong to k members, so the greatest of them is a bound of the k-th distance.
    """
    best, found, held = np.full((len(v), k), np.inf, np.float32), [], 0
    upto = np.zeros((len(v), 1), np.float32)
    for a in range(0, len(low), COLUMNS):
        d = v @ low[a : a + COLUMNS].T
        d += norm[a : a + COLUMNS]  # the square of v is left out
        here = (own[1] >= a) & (own[1] < a + d.shape[1])
        d[own[0][here], own[1][here] - a] = np.inf
        run = max(1, min(RUN, d.shape[1] // (4 * k)))
        even = d.shape[1] // run * run
        best = np.partition(np.concatenate([best, d[:, :even].reshape(len(v), run, -1).min(1), d[:, even:]], 1), k - 1, axis=1)[:, :k]
        cut = best[:, k - 1 :].astype(float)
        upto = np.where(np.isfinite(cut), cut + slack, np.finfo(np.float32).max).astype(np.float32)
        at = np.flatnonzero(d <= upto)
        i, j = np.divmod(at, d.shape[1])
        found.append((i, j + a, d.ravel()[at]))
        held += len(at)
        if held > 8 * k * len(v) or a + COLUMNS >= len(low):
            i, j, near = (np.concatenate(c) for c in zip(*found, strict=True))
            keep = near <= upto[i, 0]
            found, held = [(i[keep], j[keep], near[keep])], int(keep.sum())
            if held > 8 * k * len(v):
                return None
    return found[0][:2]


def _plain(v: np.ndarray, x: np.ndarray, norm: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """As _close, in double precision and over all members at once."""
    d = -2 * v @ x.T
    d += norm
    d[own] = np.inf
    cut = np.partition(d, k - 1, axis=1)[:, k - 1]
    upto = np.where(np.isfinite(cut), cut + 1e-9 * (1 + np.abs(cut) + np.einsum("ij,ij->i", v, v)), np.finfo(float).max)
    return np.divmod(np.flatnonzero(d <= upto[:, None]), len(x))


def _nearest(q: np.ndarray, qid: np.ndarray, qg: np.ndarray | None, x: np.ndarray, xid: np.ndarray, xg: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, distance) of each query's k nearest members of each group, itself apart, by (distance, id).

    Candidates come from the expanded square, in single precision where norms allow it and it tells members apart, with slack for all that
    rounding can do; they get the plain sum of squares, which no cancellation blurs. A tile of distances is held at once, or AT_ONCE in
    double precision (one query's, if it has more members).
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sort = np.lexsort((xid, xg))
    if (sort[1:] < sort[:-1]).any():  # else in place, no copy
        x, xid, xg = x[sort], xid[sort], xg[sort]
    norm, far = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    most = max(norm.max(initial=0), far.max(initial=0))
    single = 1e-20 < most < 1e30  # not if nan
    low, square = (x.astype(np.float32), norm.astype(np.float32)) if single else (x, norm)
    slack = (x.shape[1] + 16) * 2.0**-22 * most
    ends = np.append(np.flatnonzero(np.append(True, xg[1:] != xg[:-1])), len(xg)) if len(xg) else np.zeros(1, int)
    for a, z in zip(ends, ends[1:], strict=False):
        ids, own, m = xid[a:z], x[a:z], min(k, int(z - a))
        step = max(1, min(ROWS, AT_ONCE // len(ids)))
        for b in range(0, len(q), ROWS):
            v, asks = q[b : b + ROWS], qid[b : b + ROWS]
            near = _close((-2 * v).astype(np.float32), low[a:z], square[a:z], _itself(ids, asks), m, slack) if single else None
            parts = [(v, asks, near)] if near is not None else [(v[c : c + step], asks[c : c + step], None) for c in range(0, len(v), step)]
            for some, named, pairs in parts:
                i, j = pairs if pairs is not None else _plain(some, own, norm[a:z], _itself(ids, named), m)
                true = np.concatenate([np.sqrt(np.einsum("ij,ij->i", diff, diff)) for c in range(0, len(i), PIECE) for diff in (some[i[c : c + PIECE]] - own[j[c : c + PIECE]],)] or [np.zeros(0)])
                keep = np.isfinite(true)
                i, j, true = i[keep], j[keep], true[keep]
                by = np.lexsort((ids[j], true, i))
                i, j, true = i[by], j[by], true[by]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((named[i[keep]], ids[j[keep]], true[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (qid[:0], xid[:0], np.zeros(0))


def nearest(queries: DataFrame, base: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """(src, dst, dist, rank, grp): the k base rows nearest to each query, never itself; with `group`, k of each group of base.

    Base vectors go to every task if they are small, which is checked; else the base is dealt into cells around pivots, and a query goes
    to those cells only that can hold a neighbour, or to all blocks where that is most of them (`pivots`); ranks are taken over what
    these give. All ways are exact.
    """
    spark = queries.sparkSession
    b = base.select("node", "x", (F.col(group).cast("string") if group else F.lit("")).alias("grp"))
    size = b.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    kind = "src long, dst long, dist double, grp string"

    def table(ids: np.ndarray, members: np.ndarray, dist: np.ndarray, own: np.ndarray, code: np.ndarray, names: pa.Array) -> list[pa.Array]:
        """own: ids of the base in any order, code: their groups as places in names."""
        by = np.argsort(own, kind="stable")
        at = by[np.searchsorted(own, members, sorter=by)] if len(members) else members
        return [pa.array(members), pa.array(ids), pa.array(dist), names.take(pa.array(code[at] if len(members) else members))]

    if (size.n or 0) * (size.d or 0) * 8 <= RESIDENT:
        got = b.toArrow()
        code = got.column("grp").combine_chunks().dictionary_encode()
        xid, xg = got.column("node").to_numpy(), code.indices.to_numpy(zero_copy_only=False)
        sort = np.lexsort((xid, xg))
        shared = spark.sparkContext.broadcast((matrix(got.column("x"))[sort], xid[sort], xg[sort], code.dictionary))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, xid, xg, names = shared.value
            for batch in batches:
                if len(xid) and batch.num_rows:
                    found = _nearest(matrix(batch.column("x")), batch.column("node").to_numpy(), None, x, xid, xg, k)
                    yield pa.RecordBatch.from_arrays(table(*found, xid, xg, names), ["src", "dst", "dist", "grp"])

        tasks = max(spark.sparkContext.defaultParallelism, 1)
        out = queries.select("node", "x").repartition(tasks, "node").mapInArrow(run, kind)
    else:
        def pair(rows: pa.Table) -> pa.Table:
            side = rows.column("side").to_numpy()
            own, ask = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            x, ids = matrix(rows.column("x")), rows.column("node").to_numpy()
            code = rows.column("grp").combine_chunks().take(pa.array(own)).dictionary_encode()
            xg = code.indices.to_numpy(zero_copy_only=False)
            found = _nearest(x[ask], ids[ask], None, x[own], ids[own], xg, k) if len(own) and len(ask) else (ids[:0], ids[:0], np.zeros(0))
            if "most" in rows.column_names and len(found[0]):
                by = ask[np.argsort(ids[ask], kind="stable")]
                near = found[2] <= rows.column("most").to_numpy()[by[np.searchsorted(ids[by], found[0])]]
                found = tuple(c[near] for c in found)
            return pa.table(table(*found, ids[own], xg, code.dictionary), ["src", "dst", "dist", "grp"])

        out = nearest_in_cells(queries, b, size.n or 0, size.d or 0, k, BLOCK, pair)
    by = ["dst", "grp"] if group else ["dst"]
    return out.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("dist", "src"))).filter(F.col("rank") <= k)


def knn_train(nodes: DataFrame, k: int) -> DataFrame:
    """k nearest training nodes of each training node. Fewer than k + 1 training nodes are an error."""
    train = nodes.filter("part = 'train'")
    if train.limit(k + 1).count() <= k:
        raise ValueError(f"{k} neighbours need more than {k} training nodes")
    return nearest(train, train, k)


def knn_query(nodes: DataFrame, k: int, part: str | None = None) -> DataFrame:
    """k nearest training nodes of each held-out node (of one part, or of both)."""
    asked = nodes.filter(F.col("part") == part) if part else nodes.filter("part <> 'train'")
    return nearest(asked, nodes.filter("part = 'train'"), k)


def symmetrised(edges: DataFrame) -> DataFrame:
    """Edges both ways, each once."""
    both = edges.select("src", "dst", "dist").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    return both.groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def sigma(train_knn: DataFrame, k: int) -> DataFrame:
    """One row: the median distance of training nodes to their k-th neighbour."""
    middle = median(train_knn.filter(F.col("rank") == k), "dist")
    return train_knn.sparkSession.range(1).select(F.lit(middle).cast("double").alias("sigma"))


def rbf(edges: DataFrame, width: DataFrame) -> DataFrame:
    """Edges with weight exp(-dist^2 / (2 sigma^2)); width is one row."""
    return edges.crossJoin(F.broadcast(width)).withColumn("weight", F.exp(-F.col("dist") * F.col("dist") / (2 * F.col("sigma") * F.col("sigma")))).drop("sigma")


def pca_knn(nodes: DataFrame, k: int = 20, symmetrise: bool = True, weighted: bool = False) -> DataFrame:
    """Neighbours among training nodes, both ways, and of held-out nodes among training nodes. Training neighbours that are needed
    twice (for the weights' width) are written once."""
    train = written(knn_train(nodes, k), "knn") if weighted else knn_train(nodes, k)
    own = symmetrised(train) if symmetrise else train.select("src", "dst", "dist")
    edges = own.unionByName(knn_query(nodes, k).select("src", "dst", "dist"))
    return rbf(edges, sigma(train, k)) if weighted else edges


def mutual(train_knn: DataFrame) -> DataFrame:
    """Edges whose reverse is there too; the distance is the mean of both."""
    back = train_knn.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("dist").alias("back"))
    return train_knn.select("src", "dst", "dist").join(back, ["src", "dst"]).select("src", "dst", ((F.col("dist") + F.col("back")) / 2).alias("dist"))


def mutual_knn(nodes: DataFrame, k: int = 20) -> DataFrame:
    """Reciprocal edges between training nodes; plain neighbours for held-out nodes."""
    return mutual(written(knn_train(nodes, k), "knn")).unionByName(knn_query(nodes, k).select("src", "dst", "dist"))


def bbknn(nodes: DataFrame, k: int = 2) -> DataFrame:
    """k nearest training nodes of each training donor, or all that a smaller donor has."""
    train = nodes.filter("part = 'train'")
    own = symmetrised(nearest(train, train, k, "donor"))
    return own.unionByName(nearest(nodes.filter("part <> 'train'"), train, k, "donor").select("src", "dst", "dist"))


def kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with kind: train->train, train->val, train->test or disallowed."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("part").alias("ps")), nodes.select(F.col("node").alias("dst"), F.col("part").alias("pd"))
    return edges.join(a, "src").join(b, "dst").withColumn("kind", F.when(F.col("ps") == "train", F.concat(F.lit("train->"), F.col("pd"))).otherwise("disallowed")).drop("ps", "pd")


def rewired(edges: DataFrame, nodes: DataFrame, factor: int = 10, seed: int = 42, rounds: int | None = None) -> DataFrame:
    """(src, dst, kind): a control with the same degrees, each kind of edge mixed by itself.

    A round pairs edges of a kind in a random order, (a, b) and (c, d), and makes them (a, d) and (c, b), unless that gives a
    loop, an edge that is there already or that two swaps make. Swaps of a round share no edge, so all can go at once. Pairs are
    made within hash buckets, so no task sorts a kind. A kind is done when `factor` times as many swaps as it has edges have
    succeeded, or ten times as many were tried: 20 * factor rounds, as a round tries half as many as edges. With `rounds` given,
    each kind goes just as many.
    """
    start = now = written(kinds(edges, nodes).select("src", "dst", "kind", F.lit(False).alias("moved")), "rewired")
    size = {r.kind: r.n for r in now.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    swaps = dict.fromkeys(size, 0)
    buckets = max(1, sum(size.values()) // 10_000)
    for r in range(rounds if rounds is not None else 20 * factor):
        going = [k for k, n in size.items() if n > 1 and (rounds is not None or swaps[k] < factor * n)]
        if not going:
            break
        rest, now = now.filter(~F.col("kind").isin(going)), now.filter(F.col("kind").isin(going))
        h = F.xxhash64(F.lit(seed), F.lit(r), "src", "dst")
        w = W.partitionBy("kind", "b").orderBy("h", "src", "dst")
        df = now.withColumns({"h": h, "b": F.pmod(F.xxhash64(F.lit(r), "dst", "src"), F.lit(buckets))})
        df = df.withColumn("i", F.row_number().over(w) - 1)
        odd = F.pmod("i", F.lit(2)) == 1
        mate = F.when(odd, F.lag("dst").over(w)).otherwise(F.lead("dst").over(w))
        df = df.withColumns({"to": mate, "pair": F.floor(F.col("i") / 2)}).select("kind", "b", "pair", "src", "dst", "to")
        there = now.select(F.col("src"), F.col("dst").alias("to"), F.lit(True).alias("there"))
        made = df.join(there, ["src", "to"], "left")
        twice = F.count("*").over(W.partitionBy("src", "to"))
        made = made.withColumn("bad", F.col("to").isNull() | (F.col("src") == F.col("to")) | F.coalesce("there", F.lit(False)) | (twice > 1))
        made = made.withColumn("stop", F.max("bad").over(W.partitionBy("kind", "b", "pair")))
        made = made.select("src", F.when(F.col("stop"), F.col("dst")).otherwise(F.col("to")).alias("dst"), "kind", (~F.col("stop")).alias("moved"))
        before, now = start, written(made.unionByName(rest.withColumn("moved", F.lit(False))), "rewired")
        start = now
        dropped(before)
        for x in now.filter("moved").groupBy("kind").agg(F.count("*").alias("n")).collect():
            swaps[x.kind] += x.n // 2
    return now.drop("moved")


def edge_hash() -> Column:
    """An aggregate over edges: what tells two graphs apart, whatever the order of rows."""
    return content_hash("src", "dst")


def manifest(edges: DataFrame, nodes: DataFrame, name: str, builder: str = "pca_knn", k: int = 20, reference_policy: str = "standard_knn", query_policy: str = "standard_knn", width: DataFrame | None = None) -> DataFrame:
    """One row that says what a graph is: how it was built, where messages flow, counts of nodes and edges by kind, and hashes of
    its edges, its weights (in millionths) and its nodes. width: the row of sigma, for weighted edges."""
    n = nodes.agg(F.count("*").alias("num_nodes"), *(F.count_if(F.col("part") == p).alias(f"num_{p}_nodes") for p in ("train", "val", "test")), content_hash("node", "part").alias("node_hash"))
    weighted = "weight" in edges.columns
    weights = content_hash("src", "dst", F.round(F.col("weight") * 1_000_000).cast("bigint")) if weighted else F.lit(None).cast("string")
    kind = kinds(edges, nodes)
    count = lambda c: F.count_if(F.col("kind") == c)
    e = kind.agg(F.count("*").alias("num_edges"), count("train->train").alias("num_train_train_edges"), count("train->val").alias("num_train_to_val_edges"), count("train->test").alias("num_train_to_test_edges"), count("disallowed").alias("num_disallowed_edges"), edge_hash().alias("edge_hash"), weights.alias("weight_hash"))
    said = {"graph_name": name, "builder_type": builder, "reference_edge_policy": reference_policy, "query_edge_policy": query_policy, "metric": "euclidean", "weighting": "rbf" if weighted else "unweighted", "edge_index_convention": "source_to_target", "message_flow_train": "train_to_train", "message_flow_validation": "train_to_validation", "message_flow_test": "train_to_test"}
    out = n.crossJoin(e).withColumns({c: F.lit(v) for c, v in said.items()} | {c: F.lit(k) for c in ("k", "nominal_train_k", "nominal_query_k")} | {"query_nodes_affect_training": F.lit(False)})  # two rows of one
    return out.crossJoin(width.select(F.col("sigma").alias("sigma_k"))) if width is not None else out.withColumn("sigma_k", F.lit(None).cast("double"))


def to_data(nodes: DataFrame) -> DataFrame:
    """What a model sees: features of all nodes, labels of training nodes only (-1 elsewhere)."""
    return nodes.select("node", "x", "part", F.when(F.col("part") == "train", F.col("y")).otherwise(-1).alias("y"))


BUILDERS: dict[str, object] = {}


def register_builder(name: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        if name in BUILDERS:
            raise ValueError(f"a graph builder {name} is there already")
        BUILDERS[name] = f
        return f

    return add


def builder(name: str):  # noqa: ANN201
    if name not in BUILDERS:
        raise KeyError(f"no graph builder {name}; there are {', '.join(sorted(BUILDERS))}")
    return BUILDERS[name]


for _name, _f in (("pca_knn", pca_knn), ("mutual_knn", mutual_knn), ("bbknn", bbknn), ("rewired_control", rewired)):
    register_builder(_name)(_f)
