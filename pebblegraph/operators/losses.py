"""Objectives: one row (graph_id, loss) for each graph, from edges and long-form memberships.

No N x N matrix is made: |A - S S'| is expanded, A^3 S is three products, S' S is a self-join on the node.
"""

from __future__ import annotations

from math import lgamma as log_gamma
from math import log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import EPS, w_or_1
from .ops import propagated

KEY = "graph_id"


def reduced_loss(losses: DataFrame, how: str = "mean") -> DataFrame:
    """One row: the mean or the sum over graphs."""
    if how not in ("mean", "sum"):
        raise ValueError(f"no reduction {how}; there are mean and sum")
    return losses.agg((F.avg if how == "mean" else F.sum)("loss").alias("loss"))


def gram(soft: DataFrame) -> DataFrame:
    """graph_id, k, l, g: the matrix S' S."""
    a, b = soft.select(KEY, "node_id", F.col("cluster_id").alias("k"), F.col("weight").alias("a")), soft.select(KEY, "node_id", F.col("cluster_id").alias("l"), F.col("weight").alias("b"))
    return a.join(b, [KEY, "node_id"]).groupBy(KEY, "k", "l").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


def edge_dots(edges: DataFrame, soft: DataFrame, inner: Column | None = None) -> DataFrame:
    """graph_id, src, dst, w, v: sum over clusters of s_src * s_dst (or of ``inner`` of columns a and b) for each edge."""
    a, b = soft.select(KEY, F.col("node_id").alias("src"), "cluster_id", F.col("weight").alias("a")), soft.select(KEY, F.col("node_id").alias("dst"), "cluster_id", F.col("weight").alias("b"))
    e = edges.select(KEY, "src", "dst", w_or_1().alias("w"))
    value = F.col("a") * F.col("b") if inner is None else inner
    return e.join(a, [KEY, "src"]).join(b, [KEY, "dst", "cluster_id"]).groupBy(KEY, "src", "dst").agg(F.max("w").alias("w"), F.sum(value).alias("v"))


def _graphs(soft: DataFrame) -> DataFrame:
    return soft.groupBy(KEY).agg(F.countDistinct("node_id").cast("double").alias("n"), (F.max("cluster_id") + 1).cast("double").alias("k"))


def _quadratic(edges: DataFrame, soft: DataFrame) -> DataFrame:
    """graph_id, num = sum_ij m_ij s_i . s_j, den = sum_i d_i |s_i|^2 by way of M S."""
    ms = propagated(edges, soft).withColumnRenamed("weight", "m")
    num = soft.join(ms, [KEY, "node_id", "cluster_id"]).groupBy(KEY).agg(F.sum(F.col("weight") * F.col("m")).alias("num"))
    d = edges.groupBy(KEY, F.col("src").alias("node_id")).agg(F.sum(w_or_1()).alias("d"))
    den = soft.join(d, [KEY, "node_id"]).groupBy(KEY).agg(F.sum(F.col("d") * F.col("weight") * F.col("weight")).alias("den"))
    return num.join(den, KEY)


def _over_graphs(soft: DataFrame, found: DataFrame, loss: Column) -> DataFrame:
    """The loss of every graph; 0 for those without edges."""
    return soft.select(KEY).distinct().join(found, KEY, "left").select(KEY, F.coalesce(loss, F.lit(0.0)).alias("loss"))


def mincut(edges: DataFrame, soft: DataFrame) -> DataFrame:
    return _over_graphs(soft, _quadratic(edges, soft), -F.col("num") / (F.col("den") + EPS))


def motif_mincut(edges: DataFrame, soft: DataFrame) -> DataFrame:
    """mincut with A^3 for A: A (A (A S)), and the degrees of A^3 by A (A (A 1))."""
    s3 = soft
    for _ in range(3):
        s3 = propagated(edges, s3)
    ones = soft.select(KEY, "node_id").distinct().select(KEY, "node_id", F.lit(0).cast("long").alias("cluster_id"), F.lit(1.0).alias("weight"))
    for _ in range(3):
        ones = propagated(edges, ones)
    num = soft.join(s3.withColumnRenamed("weight", "m"), [KEY, "node_id", "cluster_id"]).groupBy(KEY).agg(F.sum(F.col("weight") * F.col("m")).alias("num"))
    den = soft.join(ones.select(KEY, "node_id", F.col("weight").alias("d")), [KEY, "node_id"]).groupBy(KEY).agg(F.sum(F.col("d") * F.col("weight") * F.col("weight")).alias("den"))
    return _over_graphs(soft, num.join(den, KEY), -F.col("num") / (F.col("den") + EPS))


def orthogonality(soft: DataFrame) -> DataFrame:
    """|S'S / |S'S| - I / sqrt K|. Cells of clusters without members count with their 0 in S'S."""
    g = gram(soft).groupBy(KEY).agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"), F.sum(F.when(F.col("k") == F.col("l"), F.col("g")).otherwise(0.0)).alias("tr"))
    # |G/|G|| = 1 and |I/sqrt K| = 1, so the square is 2 - 2 tr G / (|G| sqrt K)
    return g.join(_graphs(soft), KEY).select(KEY, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("tr") / (F.col("norm") * F.sqrt("k")))).alias("loss"))


def hosc_orthogonality(soft: DataFrame) -> DataFrame:
    cols = soft.groupBy(KEY, "cluster_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("c")).groupBy(KEY).agg(F.sum("c").alias("c"))
    loss = (F.sqrt("k") - F.col("c") / F.sqrt("n")) / (F.sqrt("k") - 1)
    return cols.join(_graphs(soft), KEY).select(KEY, F.when(F.col("k") <= 1, 0.0).otherwise(loss).alias("loss"))


def link_prediction(edges: DataFrame, soft: DataFrame, normalize: bool = False) -> DataFrame:
    """One row for the whole batch: |A - S S'| (over the cells, if normalised)."""
    e = edge_dots(edges, soft).agg(F.coalesce(F.sum((F.col("w") - F.col("v")) * (F.col("w") - F.col("v")) - F.col("v") * F.col("v")), F.lit(0.0)).alias("e"))
    g = gram(soft).agg(F.sum(F.col("g") * F.col("g")).alias("g"))
    cells = _graphs(soft).agg(F.sum(F.col("n") * F.col("n")).alias("cells"))
    loss = F.sqrt(F.greatest(F.col("e") + F.col("g"), F.lit(0.0)))
    one = e.join(F.broadcast(g), how="inner").join(F.broadcast(cells), how="inner")  # three tables of one row
    return one.select((loss / F.col("cells") if normalize else loss).alias("loss"))


def entropy(soft: DataFrame) -> DataFrame:
    s = soft.groupBy(KEY).agg(F.sum(-F.col("weight") * F.log(F.col("weight") + EPS)).alias("e"))
    return s.join(_graphs(soft), KEY).select(KEY, (F.col("e") / F.col("n")).alias("loss"))


def _all_pairs_filled(soft: DataFrame) -> DataFrame:
    """Memberships with a row for every node and cluster of its graph."""
    k = soft.groupBy(KEY).agg(F.max("cluster_id").alias("k"))
    cells = soft.select(KEY, "node_id").distinct().join(k, KEY).select(KEY, "node_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("cluster_id"))
    return cells.join(soft.select(KEY, "node_id", "cluster_id", "weight"), [KEY, "node_id", "cluster_id"], "left").na.fill({"weight": 0.0})


def total_variation(edges: DataFrame, soft: DataFrame) -> DataFrame:
    """sum w |s_i - s_j|_1 / (2 max(|E|, 1))."""
    d = edge_dots(edges, _all_pairs_filled(soft), F.abs(F.col("a") - F.col("b"))).groupBy(KEY).agg((F.sum(F.col("w") * F.col("v")) / (2 * F.count(F.lit(1)))).alias("t"))
    return _over_graphs(soft, d, F.col("t"))


def asymmetric_norm(soft: DataFrame) -> DataFrame:
    """Balance: the value of rank floor(n / K) in each column is its quantile q; deviations above q weigh K - 1."""
    full = _all_pairs_filled(soft).join(_graphs(soft), KEY)
    r = full.withColumn("r", F.row_number().over(Window.partitionBy(KEY, "cluster_id").orderBy(F.col("weight").desc(), "node_id")) - 1)
    at = F.least(F.floor(F.col("n") / F.col("k")), F.col("n") - 1)
    q = r.where(F.col("r") == at).select(KEY, "cluster_id", F.col("weight").alias("q"))
    d = F.col("weight") - F.col("q")
    s = full.join(q, [KEY, "cluster_id"]).groupBy(KEY).agg(F.sum(F.when(d >= 0, (F.col("k") - 1) * d).otherwise(-d)).alias("a"), F.max("n").alias("n"), F.max("k").alias("k"))
    top = F.col("n") * (F.col("k") - 1)
    return s.select(KEY, F.when(F.col("k") <= 1, 0.0).otherwise((top - F.col("a")) / top).alias("loss"))


def just_balance(soft: DataFrame) -> DataFrame:
    d = _all_pairs_filled(soft).groupBy(KEY, "cluster_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("c")).groupBy(KEY).agg(F.sum(F.sqrt(F.col("c") + EPS)).alias("c"))
    return d.join(_graphs(soft), KEY).select(KEY, (-F.col("c") / F.sqrt(F.col("n") * F.col("k"))).alias("loss"))


def spectral(edges: DataFrame, soft: DataFrame) -> DataFrame:
    """-(tr S'AS - |S'd|^2 / 2m) / 2m; 0 without edges."""
    num = soft.join(propagated(edges, soft).withColumnRenamed("weight", "m"), [KEY, "node_id", "cluster_id"]).groupBy(KEY).agg(F.sum(F.col("weight") * F.col("m")).alias("tr"))
    d = edges.groupBy(KEY, F.col("src").alias("node_id")).agg(F.sum(w_or_1()).alias("d"))
    sd = soft.join(d, [KEY, "node_id"]).groupBy(KEY, "cluster_id").agg(F.sum(F.col("weight") * F.col("d")).alias("sd")).groupBy(KEY).agg(F.sum(F.col("sd") * F.col("sd")).alias("sd"))
    m = edges.groupBy(KEY).agg(F.sum(w_or_1()).alias("m2"))
    return _over_graphs(soft, num.join(sd, KEY).join(m, KEY), -(F.col("tr") - F.col("sd") / F.col("m2")) / F.col("m2"))


def cluster_size(soft: DataFrame) -> DataFrame:
    """|column sums| / n * sqrt K - 1."""
    c = soft.groupBy(KEY, "cluster_id").agg(F.sum("weight").alias("c")).groupBy(KEY).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("c"))
    return c.join(_graphs(soft), KEY).select(KEY, (F.col("c") / F.col("n") * F.sqrt("k") - 1).alias("loss"))


def _logits(pairs: DataFrame, soft: DataFrame, k_matrix: list[list[float]]) -> DataFrame:
    """pairs (graph_id, src, dst, ...) with z = s_src K s_dst."""
    cell = F.lit(0.0)
    for i, row in enumerate(k_matrix):
        for j, v in enumerate(row):
            cell = cell + F.when((F.col("_k") == i) & (F.col("_l") == j), F.lit(float(v))).otherwise(0.0)
    a, b = soft.select(KEY, F.col("node_id").alias("src"), F.col("cluster_id").alias("_k"), F.col("weight").alias("_a")), soft.select(KEY, F.col("node_id").alias("dst"), F.col("cluster_id").alias("_l"), F.col("weight").alias("_b"))
    z = pairs.select(KEY, "src", "dst").join(a, [KEY, "src"]).join(b, [KEY, "dst"]).groupBy(KEY, "src", "dst").agg(F.sum(F.col("_a") * cell * F.col("_b")).alias("z"))
    return pairs.join(z, [KEY, "src", "dst"])


def _bce(z: Column, y: Column, positive: Column | None = None) -> Column:
    soft = F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    return (y if positive is None else y * positive) * soft + (1 - y) * (z + soft)


def weighted_bce(nodes: DataFrame, edges: DataFrame, soft: DataFrame, k_matrix: list[list[float]]) -> DataFrame:
    """Reconstruction over all pairs of a graph, positives weighted by non-edges per edge, over n^2. For graphs that fit a task."""
    a, b = nodes.select(KEY, F.col("node_id").alias("src")), nodes.select(KEY, F.col("node_id").alias("dst"))
    e = edges.select(KEY, "src", "dst").distinct().withColumn("y", F.lit(1.0))
    pairs = _logits(a.join(b, KEY).join(e, [KEY, "src", "dst"], "left").na.fill({"y": 0.0}), soft, k_matrix)
    w = Window.partitionBy(KEY)
    p = pairs.withColumns({"_e": F.sum("y").over(w), "_c": F.count(F.lit(1)).over(w)})
    p = p.withColumn("_w", (F.col("_c") - F.col("_e")) / F.greatest(F.col("_e"), F.lit(1.0)))
    return p.groupBy(KEY).agg((F.sum(_bce(F.col("z"), F.col("y"), F.col("_w"))) / F.max("_c")).alias("loss"))


def sparse_bce(edges: DataFrame, negatives: DataFrame, soft: DataFrame, k_matrix: list[list[float]]) -> DataFrame:
    """graph_id, loss, n_edges: reconstruction over edges and sampled non-edges."""
    pairs = edges.select(KEY, "src", "dst", F.lit(1.0).alias("y")).unionByName(negatives.select(KEY, "src", "dst", F.lit(0.0).alias("y")))
    return _logits(pairs, soft, k_matrix).groupBy(KEY).agg(F.avg(_bce(F.col("z"), F.col("y"))).alias("loss"), F.count(F.lit(1)).alias("n_edges"))


def _shifted(x: Column) -> tuple[Column, list[Column]]:
    """x + 8, where the asymptotic series below hold to 1e-11, and the eight steps up to there."""
    return x + 8.0, [x + float(i) for i in range(8)]


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive column, by recurrence and Stirling's series."""
    y, steps = _shifted(x)
    r = 1 / (y * y)
    stirling = (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return stirling - sum((F.log(s) for s in steps), F.lit(0.0))


def digamma(x: Column) -> Column:
    """Its derivative, by recurrence and the asymptotic series."""
    y, steps = _shifted(x)
    r = 1 / (y * y)
    return F.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - sum((1 / s for s in steps), F.lit(0.0))


def kl_beta(sticks: DataFrame, alpha: float, beta: float) -> DataFrame:
    """KL(Beta(a, b) | Beta(alpha, beta)) summed over rows (graph_id, a, b), in closed form."""
    p, q, s = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    prior = log_gamma(alpha) + log_gamma(beta) - log_gamma(alpha + beta)
    kl = prior - (lgamma(p) + lgamma(q) - lgamma(s)) + (p - alpha) * digamma(p) + (q - beta) * digamma(q) + (alpha - p + beta - q) * digamma(s)
    return sticks.groupBy(KEY).agg(F.sum(kl).alias("loss"))


def k_prior(k_matrix: list[list[float]], mean: float, variance: float, graphs: int = 1) -> float:
    """(K - mu)^2 / 2 var, summed; mu is +mean on the diagonal and -mean off it; over the graphs."""
    return sum(0.5 * (v - (mean if i == j else -mean)) ** 2 / variance for i, row in enumerate(k_matrix) for j, v in enumerate(row)) / graphs


def maxcut(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """z'Az over the graph's volume, for (graph_id, node_id, score)."""
    a, b = scores.select(KEY, F.col("node_id").alias("src"), F.col("score").alias("a")), scores.select(KEY, F.col("node_id").alias("dst"), F.col("score").alias("b"))
    e = edges.select(KEY, "src", "dst", w_or_1().alias("w")).join(a, [KEY, "src"]).join(b, [KEY, "dst"]).groupBy(KEY).agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("cut"), F.sum("w").alias("vol"))
    return _over_graphs(scores, e, F.col("cut") / F.when(F.col("vol") == 0, 1.0).otherwise(F.col("vol")))
