"""LIFT: supernode features back to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import pseudo_inverse
from .reduce import aggregated


def inverse_hard(assign: DataFrame) -> DataFrame:
    """Rows of the transposed pseudo-inverse of a hard assignment: w_i over the sum of its cluster's w squared."""
    total = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("graph_id", "cluster_id"))
    return assign.select("graph_id", "node_id", "cluster_id", (F.col("weight") / total).alias("weight"))


def lifted(pooled: DataFrame, assign: DataFrame, nodes: DataFrame, dims: int, matrix: str = "transpose", op: str = "sum") -> DataFrame:
    """nodes with x from their supernodes (pooled: graph_id, node_id, x); nodes without one get zeros.

    matrix: transpose (memberships as they are), inverse (of a hard assignment), soft_inverse (a solve for each graph), or
    precomputed (assign is the matrix).
    """
    kinds = {"transpose": lambda a: a, "precomputed": lambda a: a, "inverse": inverse_hard, "soft_inverse": pseudo_inverse}
    if matrix not in kinds:
        raise ValueError(f"no matrix {matrix}; there are {', '.join(kinds)}")
    a = kinds[matrix](assign)
    p = pooled.select("graph_id", F.col("node_id").alias("cluster_id"), *(F.col("x")[i].alias(f"x{i}") for i in range(dims)))
    rows = a.join(p, ["graph_id", "cluster_id"]).select("graph_id", "node_id", *((F.col("weight") * F.col(f"x{i}")).alias(f"x{i}") for i in range(dims)))
    got = aggregated(rows, ["graph_id", "node_id"], dims, op)
    return nodes.select("graph_id", "node_id").join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("x", F.array_repeat(F.lit(0.0), dims)).alias("x"))


def eigen_lifted(pooled: DataFrame, theta: DataFrame, dims: int) -> DataFrame:
    """Nodes from pooled rows whose x are modes of ``dims`` features each: sum over modes of theta * x."""
    p = pooled.select("graph_id", F.col("node_id").alias("cluster_id"), F.posexplode("x").alias("pos", "v")).select("graph_id", "cluster_id", F.floor(F.col("pos") / dims).cast("int").alias("mode"), (F.col("pos") % dims).alias("f"), "v")
    rows = theta.join(p, ["graph_id", "cluster_id", "mode"])
    return rows.groupBy("graph_id", "node_id").agg(F.array(*(F.sum(F.when(F.col("f") == i, F.col("value") * F.col("v")).otherwise(0.0)) for i in range(dims))).alias("x"))
