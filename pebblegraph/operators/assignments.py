"""Whole assignments: unions of them, their parts, supernodes without gaps, labels, and parents in a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import ASSIGN, Graph, check, w_or_1
from ..plans.fixpoint import hashed, ranked, running_sums, stored


def collated_assigns(assigns: list[DataFrame]) -> DataFrame:
    """The disjoint union; graph ids are numbered in the order given, cluster ids stay their graph's own.

    Assignments with other columns than the first one's are refused.
    """
    if not assigns:
        raise ValueError("no assignments")
    out = None
    for k, a in enumerate(assigns):
        if set(a.columns) != set(assigns[0].columns):
            raise ValueError(f"assignment {k} has the columns {', '.join(a.columns)}, the first one {', '.join(assigns[0].columns)}")
        one = check(a, ASSIGN, "assign").withColumn("graph_id", F.lit(k).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def rebased(assign: DataFrame) -> DataFrame:
    """Each graph's clusters numbered from 0 on."""
    least = assign.groupBy("graph_id").agg(F.min("cluster_id").alias("_least"))
    return assign.join(least, "graph_id").withColumn("cluster_id", F.col("cluster_id") - F.col("_least")).drop("_least")


def separated_assign(assign: DataFrame, graph_id: int) -> DataFrame:
    """One graph of a union, its clusters numbered from 0 on."""
    return rebased(assign.where(F.col("graph_id") == graph_id))


def block_clusters(assign: DataFrame) -> DataFrame:
    """Cluster ids that are unique over all graphs: each graph's follow those of the graphs before it."""
    size = assign.groupBy("graph_id").agg((F.max("cluster_id") + 1).alias("_k"))
    offset = running_sums(size, "graph_id", "_k", "_offset")
    return assign.join(offset.select("graph_id", "_offset"), "graph_id").withColumn("cluster_id", F.col("cluster_id") + F.col("_offset")).drop("_offset")


def compacted(nodes: DataFrame, edges: DataFrame, valid: DataFrame) -> Graph:
    """The pooled graph without the supernodes that ``valid`` (graph_id, cluster_id, valid) rules out; the others are numbered anew."""
    kept = valid.where("valid").select("graph_id", F.col("cluster_id").alias("node_id"))
    ids = ranked(kept, ["graph_id"], [F.col("node_id")], "_new", spread=True).select("graph_id", "node_id", "_new")
    n = nodes.join(ids, ["graph_id", "node_id"]).withColumn("node_id", F.col("_new")).drop("_new")
    e = edges.join(ids.select("graph_id", F.col("node_id").alias("src"), F.col("_new").alias("_s")), ["graph_id", "src"]).join(ids.select("graph_id", F.col("node_id").alias("dst"), F.col("_new").alias("_d")), ["graph_id", "dst"])
    return Graph(n, e.select("graph_id", F.col("_s").alias("src"), F.col("_d").alias("dst"), "weight"))


def one_hot_labels(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """graph_id, node_id, label of every node: its place from 1 on among the kept nodes of its graph by id, or 0."""
    ids = ranked(kept.select("graph_id", "node_id").distinct(), ["graph_id"], [F.col("node_id")], "_i", spread=True)
    out = nodes.select("graph_id", "node_id").join(ids, ["graph_id", "node_id"], "left")
    return out.select("graph_id", "node_id", F.coalesce(F.col("_i") + 1, F.lit(0)).cast("long").alias("label"))


def parents(pairs: DataFrame) -> DataFrame:
    """graph_id, child, parent, one row a child of (graph_id, child, parent); a child of two parents fails the query."""
    both = pairs.groupBy("graph_id", "child").agg(F.min("parent").alias("parent"), F.max("parent").alias("_most"))
    wrong = F.raise_error(F.concat(F.lit("child "), F.col("child").cast("string"), F.lit(" has two parents"))).cast("long")
    return both.select("graph_id", "child", F.when(F.col("parent") == F.col("_most"), F.col("parent")).otherwise(wrong).alias("parent"))


def partition_entropy(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """graph_id, entropy: the structural entropy of the tree of root, clusters and nodes, of a hard assignment.

    The sum over its nodes of -cut / volume * log2(own volume / parent's volume). Edges are undirected, without loops. They are
    read once: all sums are those of one row a node. A node's edges meet last at their src, by which they are summed.
    """
    e = edges.where("src <> dst").select("graph_id", "src", "dst", w_or_1().alias("w"))
    a = hashed(assign.select("graph_id", "node_id", "cluster_id"), "graph_id", "node_id")
    e = e.join(a.select("graph_id", F.col("node_id").alias("dst"), F.col("cluster_id").alias("d")), ["graph_id", "dst"]).join(a.select("graph_id", F.col("node_id").alias("src"), F.col("cluster_id").alias("c")), ["graph_id", "src"])
    own = stored(e.groupBy("graph_id", "c", "src").agg(F.sum("w").alias("v"), F.sum(F.when(F.col("c") != F.col("d"), F.col("w")).otherwise(0.0)).alias("g")))
    cluster = own.groupBy("graph_id", "c").agg(F.sum("v").alias("vc"), F.sum("g").alias("g"))
    total = cluster.groupBy("graph_id").agg(F.sum("vc").alias("vol"))
    leaves = own.drop("g").join(hashed(cluster.drop("g"), "graph_id", "c"), ["graph_id", "c"]).groupBy("graph_id").agg(F.sum(F.col("v") * F.log2(F.col("v") / F.col("vc"))).alias("a"))
    inner = cluster.join(total, "graph_id").groupBy("graph_id").agg(F.sum(F.col("g") * F.log2(F.col("vc") / F.col("vol"))).alias("b"))
    return total.join(leaves, "graph_id").join(inner, "graph_id").select("graph_id", (-(F.col("a") + F.col("b")) / F.col("vol")).alias("entropy"))
