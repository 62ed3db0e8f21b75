"""Message passing as joins and aggregations with literal weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import activation, affine
from ..graph import w_or_1
from .ops import add_remaining_self_loops, coalesced


def _cols(prefix: str, dims: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(dims)]


def _flat(nodes: DataFrame, dims: int, prefix: str = "x") -> DataFrame:
    return nodes.select("graph_id", "node_id", *(F.col("x")[i].alias(f"{prefix}{i}") for i in range(dims)))


def weighted_sum(nodes: DataFrame, edges: DataFrame, dims: int) -> DataFrame:
    """x_i = sum over edges i -> j of w x_j; zeros without edges."""
    n = _flat(nodes, dims).withColumnRenamed("node_id", "dst")
    got = edges.join(n, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array(*(F.sum(w_or_1() * F.col(c)) for c in _cols("x", dims))).alias("x"))
    return nodes.select("graph_id", "node_id").join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("x", F.array_repeat(F.lit(0.0), dims)).alias("x"))


def graph_conv(nodes: DataFrame, edges: DataFrame, w_self: list[list[float]], w_near: list[list[float]], bias: list[float] | None = None, act: str | None = None) -> DataFrame:
    """x_i W1 + sum_j x_j W2 over edges j -> i (unweighted where weights are null)."""
    dims = len(w_self)
    n = _flat(nodes, dims).withColumnRenamed("node_id", "src")
    got = edges.join(n, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.array(*(F.sum(w_or_1() * F.col(c)) for c in _cols("x", dims))).alias("m"))
    f = activation(act)
    own, near = affine(F.col("x"), w_self, bias), affine(F.coalesce("m", F.array_repeat(F.lit(0.0), dims)), w_near)
    return nodes.join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.transform(F.zip_with(own, near, lambda a, b: a + b), f).alias("x"))


def gtv_weights(nodes: DataFrame, edges: DataFrame, coeff: float = 1.0) -> DataFrame:
    """I - coeff * (D - A) with in-degrees; loops of weight 0 are added where there are none."""
    e = add_remaining_self_loops(nodes, edges, 0.0)
    d = e.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum(w_or_1()).alias("d"))
    off = e.select("graph_id", "src", "dst", (coeff * w_or_1()).alias("weight"))
    diagonal = d.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), (1 - coeff * F.col("d")).alias("weight"))
    return coalesced(off.unionByName(diagonal))


def gtv_conv(nodes: DataFrame, edges: DataFrame, weights: list[list[float]], bias: list[float] | None = None, delta: float = 1.0, eps: float = 1e-3, act: str | None = "relu") -> DataFrame:
    """Total-variation convolution: y = x W; edge weights over max(|y_i - y_j|_1, eps); (I - delta L) y + b."""
    outs = len(weights[0])
    y = nodes.select("graph_id", "node_id", affine(F.col("x"), weights).alias("x"))
    flat = _flat(y, outs, "a").withColumnRenamed("node_id", "src")
    other = _flat(y, outs, "b").withColumnRenamed("node_id", "dst")
    far = sum((F.abs(F.col(f"a{i}") - F.col(f"b{i}")) for i in range(outs)), F.lit(0.0))
    gamma = edges.where("src <> dst").join(flat, ["graph_id", "src"]).join(other, ["graph_id", "dst"]).select("graph_id", "src", "dst", (w_or_1() / F.greatest(far, F.lit(eps))).alias("weight"))
    mixed = weighted_sum(y, gtv_weights(nodes, gamma, delta), outs)
    f = activation(act)
    b = F.array(*(F.lit(float(v)) for v in (bias or [0.0] * outs)))
    return mixed.select("graph_id", "node_id", F.transform(F.zip_with("x", b, lambda p, q: p + q), f).alias("x"))


def local_extremum(nodes: DataFrame, edges: DataFrame, w1: list[float], w2: list[float], w3: list[float]) -> DataFrame:
    """graph_id, node_id, score = x_i . w1 + sum_j w_ij (x_i . w2 - x_j . w3) over edges j -> i."""
    col = lambda w: affine(F.col("x"), [[v] for v in w])[0]
    n = nodes.select("graph_id", "node_id", col(w1).alias("p"), col(w2).alias("q"), col(w3).alias("r"))
    got = edges.join(n.select("graph_id", F.col("node_id").alias("src"), "r"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum(w_or_1()).alias("d"), F.sum(w_or_1() * F.col("r")).alias("m"))
    return n.join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", (F.col("p") + F.coalesce(F.col("d") * F.col("q") - F.col("m"), F.lit(0.0))).alias("score"))


def sorted_nodes(nodes: DataFrame, edges: DataFrame, by: str = "y") -> tuple[DataFrame, DataFrame]:
    """Nodes numbered anew by a label column, and edges with the new numbers."""
    from ..plans.fixpoint import ranked

    r = ranked(nodes, ["graph_id"], [F.col(by), F.col("node_id")], "_new")
    m = r.select("graph_id", "node_id", "_new")
    e = edges.join(m.select("graph_id", F.col("node_id").alias("src"), F.col("_new").alias("s")), ["graph_id", "src"]).join(m.select("graph_id", F.col("node_id").alias("dst"), F.col("_new").alias("d")), ["graph_id", "dst"])
    return r.drop("node_id").withColumnRenamed("_new", "node_id"), e.select("graph_id", F.col("s").alias("src"), F.col("d").alias("dst"), "weight")
