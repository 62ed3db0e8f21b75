"""CONNECT: edges between supernodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EPS, w_or_1
from ..plans.fixpoint import hashed
from .ops import coalesced, degree_normed, max_normed, propagated


def relabelled(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Edges between clusters, one row for each edge whose ends are both assigned."""
    a = hashed(assign.select("graph_id", "node_id", "cluster_id"), "graph_id", "node_id")
    e = edges.select("graph_id", "src", "dst", "weight").join(a.select("graph_id", F.col("node_id").alias("src"), F.col("cluster_id").alias("cs")), ["graph_id", "src"])
    e = e.join(a.select("graph_id", F.col("node_id").alias("dst"), F.col("cluster_id").alias("cd")), ["graph_id", "dst"])
    return e.select("graph_id", F.col("cs").alias("src"), F.col("cd").alias("dst"), "weight")


def postprocessed(edges: DataFrame, self_loops: bool = False, degree_norm: bool = False, weight_norm: bool = False, degree_by: str = "src", eps: float | None = EPS) -> DataFrame:
    """In this order: loops go, tiny weights go, degrees are normed, weights are divided by the graph's largest."""
    e = edges if self_loops else edges.where("src <> dst")
    if eps is not None:
        e = e.where(F.col("weight").isNull() | (F.abs("weight") > eps))
    if degree_norm:
        e = degree_normed(e, degree_by)
    return max_normed(e) if weight_norm else e


def sparse_connect(edges: DataFrame, assign: DataFrame, op: str | None = "sum", self_loops: bool = False, degree_norm: bool = False, weight_norm: bool = False) -> DataFrame:
    """Edges of hard assignments; memberships do not count. op None: an induced subgraph, nothing is merged."""
    e = relabelled(edges, assign)
    return postprocessed(e if op is None else coalesced(e, op), self_loops, degree_norm, weight_norm)


def dense_connect(edges: DataFrame, soft: DataFrame, self_loops: bool = False, degree_norm: bool = True, adj_transpose: bool = True, weight_norm: bool = False) -> DataFrame:
    """S' A S with memberships. A S is summed first, so rows are edges times clusters, never clusters squared."""
    half = propagated(edges, soft).withColumnRenamed("cluster_id", "dst").withColumnRenamed("weight", "_v")
    s = soft.select("graph_id", "node_id", F.col("cluster_id").alias("src"), F.col("weight").alias("_s"))
    e = half.join(s, ["graph_id", "node_id"]).groupBy("graph_id", "src", "dst").agg(F.sum(F.col("_s") * F.col("_v")).alias("weight"))
    return postprocessed(e, self_loops, degree_norm, weight_norm, "dst" if adj_transpose else "src", None)


def external_connect(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Edges between clusters only; what is within a cluster is dropped before it is summed."""
    return relabelled(edges, assign).where("src <> dst").groupBy("graph_id", "src", "dst").agg(F.sum(w_or_1()).alias("weight"))


def eliminated(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Kron reduction by joins, where no two nodes of ``gone`` (graph_id, node_id) are neighbours.

    Eliminating v adds w_iv w_vj / deg(v) between each two neighbours. Edges are undirected (both rows).
    """
    e = edges.where("src <> dst").select("graph_id", "src", "dst", w_or_1().alias("weight"))
    g = gone.select("graph_id", F.col("node_id").alias("v"))
    spokes = e.join(g.withColumnRenamed("v", "dst"), ["graph_id", "dst"], "left_semi").select("graph_id", F.col("dst").alias("v"), F.col("src").alias("i"), F.col("weight").alias("w"))
    deg = spokes.groupBy("graph_id", "v").agg(F.sum("w").alias("d"))
    a, b = spokes.alias("a"), spokes.alias("b")
    pairs = a.join(b, (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.i") != F.col("b.i"))).select(F.col("a.graph_id").alias("graph_id"), F.col("a.v").alias("v"), F.col("a.i").alias("src"), F.col("b.i").alias("dst"), (F.col("a.w") * F.col("b.w")).alias("ww"))
    filled = pairs.join(deg, ["graph_id", "v"]).select("graph_id", "src", "dst", (F.col("ww") / F.col("d")).alias("weight"))
    kept = e.join(g.withColumnRenamed("v", "src"), ["graph_id", "src"], "left_anti").join(g.withColumnRenamed("v", "dst"), ["graph_id", "dst"], "left_anti").select("graph_id", "src", "dst", "weight")
    return coalesced(kept.unionByName(filled), "sum")
