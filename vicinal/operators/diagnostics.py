"""What a graph looks like: degrees, components, homophily, purity, mixing of donors and sites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.functions.ranks import median
from vicinal.functions.scalars import share
from vicinal.session import dropped, written


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_in, n_out), zeros included."""
    i = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    o = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    return nodes.select("node").join(i, "node", "left").join(o, "node", "left").na.fill(0, ["n_in", "n_out"])


def degree_summary(deg: DataFrame) -> DataFrame:
    rows = deg.select(F.explode(F.array(F.struct(F.lit("in").alias("side"), F.col("n_in").alias("n")), F.struct(F.lit("out").alias("side"), F.col("n_out").alias("n")))).alias("s")).select("s.*")
    return rows.groupBy("side").agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.stddev_pop("n").alias("sd"), F.min("n").alias("least"), F.max("n").alias("most"))


def isolated(deg: DataFrame) -> DataFrame:
    none = F.count_if(F.col("n_in") + F.col("n_out") == 0)
    return deg.agg(none.alias("isolated"), share(none, F.count("*")).alias("fraction"))


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n"))
    e = edges.agg(F.count("*").alias("e"))
    return e.crossJoin(n).select("e", "n", share(F.col("e"), F.col("n") * (F.col("n") - 1)).alias("density"))


def reached(links: DataFrame) -> DataFrame:
    """(node, comp) for every end of links (src, dst): comp is the least node it reaches. No links give no rows.

    Each round takes the least label among neighbours, then the label's label, so paths halve. Every round ends in a written
    table, and the one before it is deleted. Minima are combined before the shuffle; a hub's rows are a skewed join that Spark
    splits.
    """
    both = written(links.select("src", "dst").union(links.select("dst", "src")).filter("src <> dst").distinct(), "links")
    labels = written(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("comp")).select(F.col("src").alias("node"), "comp", F.lit(True).alias("moved")), "labels")
    while labels.filter("moved").limit(1).count():
        least = both.join(labels.select(F.col("node").alias("dst"), "comp"), "dst").groupBy("src").agg(F.min("comp").alias("least")).withColumnRenamed("src", "node")
        near = labels.select("node", F.col("comp").alias("was")).join(least, "node").select("node", "was", F.least("was", "least").alias("now"))
        jump = near.select(F.col("node").alias("now"), F.col("now").alias("further"))
        before, labels = labels, written(near.join(jump, "now").select("node", F.least("now", "further").alias("comp"), (F.least("now", "further") < F.col("was")).alias("moved")), "labels")
        dropped(before)
    dropped(both)
    return labels.select("node", "comp")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): weakly connected components by least node; lone nodes are their own."""
    return nodes.select("node").join(reached(edges), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def component_summary(comp: DataFrame) -> DataFrame:
    size = comp.groupBy("comp").agg(F.count("*").alias("n"))
    return size.agg(F.count("*").alias("components"), F.max("n").alias("largest"), share(F.max("n"), F.sum("n")).alias("fraction"))


def attributed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with label, donor, site and part of both ends."""
    cols = ["y", "donor", "site", "part"]
    a = nodes.select(F.col("node").alias("src"), *(F.col(c).alias(f"s_{c}") for c in cols))
    b = nodes.select(F.col("node").alias("dst"), *(F.col(c).alias(f"d_{c}") for c in cols))
    return edges.join(a, "src").join(b, "dst")


def edge_homophily(ends: DataFrame) -> DataFrame:
    same = (F.col("s_y") == F.col("d_y")).cast("int")
    return ends.agg(F.avg(same).alias("overall"), F.avg(F.when((F.col("s_part") == "train") & (F.col("d_part") == "train"), same)).alias("train"))


def node_purity(ends: DataFrame) -> DataFrame:
    """(dst, part, y, purity): for nodes with in-edges the share from nodes of the same label."""
    return ends.groupBy("dst", F.col("d_part").alias("part"), F.col("d_y").alias("y")).agg(F.avg((F.col("s_y") == F.col("d_y")).cast("int")).alias("purity"))


def node_homophily(purity: DataFrame) -> DataFrame:
    """One row: means over nodes with in-edges, overall and by part."""
    return purity.agg(F.avg("purity").alias("overall"), *(F.avg(F.when(F.col("part") == p, F.col("purity"))).alias(p) for p in ("train", "val", "test")))


def expected(nodes: DataFrame) -> DataFrame:
    """One row: homophily that class shares alone would give, overall and for train with each part."""
    n = nodes.groupBy("y").agg(F.count("*").alias("a"), *(F.count_if(F.col("part") == p).alias(p) for p in ("train", "val", "test")))
    t = n.agg(*(F.sum(c).alias(f"n_{c}") for c in ("a", "train", "val", "test")))
    p = n.crossJoin(F.broadcast(t))  # one row
    of = lambda c: share(F.col(c), F.col(f"n_{c}"))
    return p.agg(F.sum(of("a") * of("a")).alias("overall"), *(F.sum(of("train") * of(q)).alias(q) for q in ("train", "val", "test")))


def class_purity(purity: DataFrame, nodes: DataFrame) -> DataFrame:
    """(y, purity) of every class among the nodes; 0 where none of its nodes has in-edges."""
    return nodes.select("y").distinct().join(purity.groupBy("y").agg(F.avg("purity").alias("purity")), "y", "left").na.fill(0.0, ["purity"])


def mixing(ends: DataFrame) -> DataFrame:
    """One row: shares of edges within a donor or a site, by kind."""
    to = lambda p: (F.col("s_part") == "train") & (F.col("d_part") == p)
    same = lambda c: (F.col(f"s_{c}") == F.col(f"d_{c}")).cast("int")
    return ends.agg(F.avg(F.when(to("train"), same("donor"))).alias("intra_donor"), F.avg(F.when(to("train"), same("site"))).alias("intra_site"), F.avg(F.when(to("val"), same("site"))).alias("val_site_match"), F.avg(F.when(to("test"), same("site"))).alias("test_site_match"))


def entropy(ends: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """(node, part, bits): entropy of the donors or sites that a node's in-edges come from; 0 without any."""
    n = ends.groupBy("dst", F.col(f"s_{by}").alias("g")).agg(F.count("*").alias("n"))
    total = n.groupBy("dst").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    bits = n.join(total, "dst").groupBy(F.col("dst").alias("node")).agg((-F.sum(p * F.log2(p + 1e-12))).alias("bits"))
    return nodes.select("node", "part").join(bits, "node", "left").na.fill(0.0, ["bits"])


def entropy_summary(bits: DataFrame) -> DataFrame:
    return bits.groupBy("part").agg(F.avg("bits").alias("bits"))


def weight_summary(edges: DataFrame) -> DataFrame:
    held = written(edges.select("weight"), "weights")
    middle = F.lit(median(held, "weight")).cast("double")
    return held.agg(F.min("weight").alias("least"), F.max("weight").alias("most"), F.avg("weight").alias("mean"), middle.alias("median"), F.stddev_pop("weight").alias("sd"))


def flattened(row: DataFrame, prefix: str) -> DataFrame:
    """One row of numbers as (metric_name, value) rows."""
    cols = F.array(*(F.struct(F.lit(f"{prefix}.{c}").alias("metric_name"), F.col(c).cast("double").alias("value")) for c in row.columns))
    return row.select(F.explode(cols).alias("m")).select("m.*")


def report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All of the above as (metric_name, value)."""
    ends = written(attributed(edges, nodes), "ends")
    purity = node_purity(ends)
    deg = degrees(edges, nodes)
    parts = [flattened(density(edges, nodes), "density"), flattened(isolated(deg), "isolated"), flattened(component_summary(components(edges, nodes)), "components"), flattened(edge_homophily(ends), "edge_homophily"), flattened(node_homophily(purity), "node_homophily"), flattened(expected(nodes), "expected"), flattened(mixing(ends), "mixing")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _received(edges: DataFrame, nodes: DataFrame, weight: Column, how: Callable[[str, str], Column]) -> DataFrame:
    """(node, x): weighted means or sums of the feature vectors of a node's sources, combined before the shuffle; a row of vectors
    an edge is joined, never one of numbers. Nodes without in-edges have zeros."""
    x = nodes.select(F.col("node").alias("src"), array_to_vector("x").alias("v"))
    got = edges.withColumn("w", weight).join(x, "src").groupBy(F.col("dst").alias("node")).agg(vector_to_array(how("v", "w")).alias("v"))
    none = F.transform("x", lambda _: F.lit(0.0))
    return nodes.select("node", "x").join(got, "node", "left").select("node", F.coalesce("v", none).alias("x"))


def mean_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, x): mean of the features of a node's sources; nodes without in-edges have 0."""
    return _received(edges.select("src", "dst"), nodes, F.lit(1.0), lambda v, w: Summarizer.mean(F.col(v), F.col(w)))


def normalised_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, x): D^-1/2 (A + I) D^-1/2 X with in-degrees, self loops included."""
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    e = edges.select("src", "dst").filter("src <> dst").unionByName(loops)
    deg = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    w = e.join(deg.select(F.col("node").alias("src"), F.col("n").alias("ns")), "src").join(deg.select(F.col("node").alias("dst"), F.col("n").alias("nd")), "dst")
    return _received(w, nodes, 1 / F.sqrt(F.col("ns").cast("double") * F.col("nd")), lambda v, w: Summarizer.sum(F.col(v), F.col(w)))
