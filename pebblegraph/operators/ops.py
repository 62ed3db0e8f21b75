"""Matrix and graph utilities as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import EPS, w_or_1
from ..plans.fixpoint import cut, ranked

REDUCERS = {"sum": F.sum, "add": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "mul": F.product}


def softmaxed(rows: DataFrame, value: Column, keys: list[str], name: str) -> DataFrame:
    """Softmax of ``value`` within groups of any size, as a new column: maxima and sums are aggregated and joined back."""
    v = rows.withColumn("_v", value)
    top = v.groupBy(*keys).agg(F.max("_v").alias("_top"))
    e = v.join(top, keys).withColumn("_e", F.exp(F.col("_v") - F.col("_top")))
    total = v.join(top, keys).groupBy(*keys).agg(F.sum(F.exp(F.col("_v") - F.col("_top"))).alias("_sum"))
    return e.join(total, keys).withColumn(name, F.col("_e") / F.col("_sum")).drop("_v", "_top", "_e", "_sum")


def degree(nodes: DataFrame, edges: DataFrame, by: str = "dst", weighted: bool = True) -> DataFrame:
    """graph_id, node_id, degree of every node: edges (or their weights) that end (by dst) or start (by src) there."""
    value = F.sum(w_or_1()) if weighted else F.count(F.lit(1)).cast("double")
    found = edges.groupBy("graph_id", F.col(by).alias("node_id")).agg(value.alias("degree"))
    return nodes.select("graph_id", "node_id").join(found, ["graph_id", "node_id"], "left").na.fill({"degree": 0.0})


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def add_remaining_self_loops(nodes: DataFrame, edges: DataFrame, fill: float = 1.0) -> DataFrame:
    """A loop of weight ``fill`` for each node that has none."""
    have = edges.where("src = dst").select("graph_id", F.col("src").alias("node_id"))
    more = nodes.select("graph_id", "node_id").join(have, ["graph_id", "node_id"], "left_anti")
    return edges.select("graph_id", "src", "dst", "weight").unionByName(more.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(float(fill)).alias("weight")))


def coalesced(edges: DataFrame, op: str = "sum") -> DataFrame:
    """One row for each pair; unweighted edges stay unweighted."""
    if op not in REDUCERS:
        raise ValueError(f"no reduction {op}; there are {', '.join(REDUCERS)}")
    return edges.groupBy("graph_id", "src", "dst").agg(REDUCERS[op]("weight").cast("double").alias("weight"))


def undirected(edges: DataFrame, op: str = "max") -> DataFrame:
    """Both directions of every edge."""
    return coalesced(edges.select("graph_id", "src", "dst", "weight").unionByName(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), op)


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in ``kept`` (graph_id, node_id)."""
    k = kept.select("graph_id", "node_id").distinct()
    return edges.join(k.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(k.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst", "weight")


def _with_degrees(edges: DataFrame, by: str = "src") -> DataFrame:
    d = edges.groupBy("graph_id", F.col(by).alias("_n")).agg(F.sum(w_or_1()).alias("_d"))
    out = edges.join(d.select("graph_id", F.col("_n").alias("src"), F.col("_d").alias("d_src")), ["graph_id", "src"], "left")
    return out.join(d.select("graph_id", F.col("_n").alias("dst"), F.col("_d").alias("d_dst")), ["graph_id", "dst"], "left").na.fill({"d_src": 0.0, "d_dst": 0.0})


def delta_gcn(nodes: DataFrame, edges: DataFrame, delta: float = 2.0) -> DataFrame:
    """I - delta * L_sym: delta * w / sqrt(d_src d_dst) off the diagonal, 1 - delta on it. Loops are dropped first."""
    off = _with_degrees(remove_self_loops(edges))
    off = off.select("graph_id", "src", "dst", (delta * w_or_1() / F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("weight"))
    diagonal = nodes.select("graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1.0 - delta).alias("weight"))
    return coalesced(off.unionByName(diagonal), "sum")


def delta_gcn_attributes(nodes: DataFrame, edges: DataFrame, dims: int, delta: float = 2.0) -> DataFrame:
    """delta_gcn() of edges with a column ``attr`` (array of ``dims``): attributes of equal edges add up, new loops have zeros."""
    kept = remove_self_loops(edges).groupBy("graph_id", "src", "dst").agg(F.array(*(F.sum(F.col("attr")[i]) for i in range(dims))).alias("attr"))
    return delta_gcn(nodes, edges, delta).join(kept, ["graph_id", "src", "dst"], "left").withColumn("attr", F.coalesce("attr", F.array_repeat(F.lit(0.0), dims)))


def degree_normed(edges: DataFrame, by: str = "src") -> DataFrame:
    """w / (sqrt d_src sqrt d_dst); degrees are sums by ``by``, at least EPS. Edges are made once, as three plans read them."""
    e = _with_degrees(cut(edges), by)
    root = lambda c: F.sqrt(F.greatest(F.col(c), F.lit(EPS)))
    return e.select("graph_id", "src", "dst", (w_or_1() / root("d_src") / root("d_dst")).alias("weight"))


def max_normed(edges: DataFrame) -> DataFrame:
    """w / max |w| of the graph (by 1 where that is 0)."""
    top = edges.groupBy("graph_id").agg(F.max(F.abs(w_or_1())).alias("_top"))
    return edges.join(top, "graph_id").select("graph_id", "src", "dst", (w_or_1() / F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top"))).alias("weight"))


def propagated(edges: DataFrame, soft: DataFrame) -> DataFrame:
    """A S in long form: (graph_id, node_id, cluster_id, weight) = sum over edges node -> j of w * s_j."""
    s = soft.select("graph_id", F.col("node_id").alias("dst"), "cluster_id", F.col("weight").alias("_s"))
    return edges.join(s, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id"), "cluster_id").agg(F.sum(w_or_1() * F.col("_s")).alias("weight"))


def trace(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id").agg(F.sum(F.when(F.col("src") == F.col("dst"), w_or_1()).otherwise(0.0)).alias("trace"))


def out_mask(assign: DataFrame, clusters: int) -> DataFrame:
    """graph_id, cluster_id, valid for clusters 0 to ``clusters`` - 1: whether its memberships sum to more than 0."""
    sums = assign.groupBy("graph_id", "cluster_id").agg(F.sum("weight").alias("_s"))
    every = assign.select("graph_id").distinct().withColumn("cluster_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(clusters - 1).cast("long"))))
    return every.join(sums, ["graph_id", "cluster_id"], "left").select("graph_id", "cluster_id", F.coalesce(F.col("_s") > 0, F.lit(False)).alias("valid"))


def is_expressive(nodes: DataFrame, assign: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """expressive: whether every node's memberships sum to one constant that is not zero (a node without rows has 0)."""
    sums = nodes.select("graph_id", "node_id").join(assign.groupBy("graph_id", "node_id").agg(F.sum("weight").alias("_s")), ["graph_id", "node_id"], "left").select(F.coalesce("_s", F.lit(0.0)).alias("_s"))
    return sums.agg(((F.max("_s") - F.min("_s") <= tolerance) & (F.abs(F.min("_s")) > tolerance)).alias("expressive"))


def edge_to_id(src: Column, dst: Column, n: int) -> Column:
    return src * n + dst


def id_to_edge(i: Column, n: int) -> tuple[Column, Column]:
    return F.floor(i / n).cast("long"), F.pmod(i, F.lit(n))


def negative_edges(nodes: DataFrame, edges: DataFrame, per_graph: int, order: str = "id", seed: int = 0, force_undirected: bool = False) -> DataFrame:
    """Up to ``per_graph`` pairs of each graph that are no edges and no loops, the first by id or by a seeded hash.

    The pairs of a graph are n * n, so this is for graphs that fit a task; sampled_negative_edges() is for larger ones.
    """
    a, b = nodes.select("graph_id", F.col("node_id").alias("src")), nodes.select("graph_id", F.col("node_id").alias("dst"))
    pairs = a.join(b, "graph_id").where("src < dst" if force_undirected else "src <> dst")
    both = edges.select("graph_id", "src", "dst")
    if force_undirected:
        both = both.union(both.select("graph_id", F.col("dst"), F.col("src")))
    free = pairs.join(both, ["graph_id", "src", "dst"], "left_anti")
    budget = per_graph // 2 if force_undirected else per_graph
    by = [F.col("src"), F.col("dst")] if order == "id" else [F.xxhash64(F.lit(seed), "graph_id", "src", "dst"), F.col("src"), F.col("dst")]
    out = ranked(free, ["graph_id"], by, "_r").where(F.col("_r") < budget).select("graph_id", "src", "dst")
    return out.union(out.select("graph_id", F.col("dst"), F.col("src"))) if force_undirected else out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, component: the smallest node of its connected component.

    Large-star and small-star rounds (Kiveris et al. 2014) over edges alone, so no component is held in one task, and
    rounds grow with the logarithm of the longest path.
    """
    here = cut(edges.where("src <> dst").select("graph_id", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        now = tuple(here.agg(F.count(F.lit(1)), F.sum(F.xxhash64("graph_id", "u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = here.union(here.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("graph_id", "u").agg(F.min("v").alias("m")).select("graph_id", "u", F.least("u", "m").alias("m"))
        large = both.join(least, ["graph_id", "u"]).where("v > u and v <> m").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("graph_id", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["graph_id", "u"]).where("v <> m").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("graph_id", "u", F.col("m").alias("v")))
        here = cut(small.distinct())
    found = here.groupBy("graph_id", F.col("u").alias("node_id")).agg(F.min("v").alias("component"))
    return nodes.select("graph_id", "node_id").join(found, ["graph_id", "node_id"], "left").withColumn("component", F.coalesce("component", "node_id"))


def sampling_plan(nodes: DataFrame, edges: DataFrame, wanted: int, low: float = 0.5, high: float = 2 / 3) -> DataFrame:
    """graph_id, share (of ordered pairs that are no edges), method, tries, for ``wanted`` pairs of each graph without an edge.

    Below ``low`` guesses would mostly fail, so all pairs are listed (dense); up to ``high`` half as many guesses more than
    wanted are made, and beyond it as many as the share asks for.
    """
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    e = remove_self_loops(edges).select("graph_id", "src", "dst").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("_e"))
    pairs = F.greatest(F.col("_n") * (F.col("_n") - 1), F.lit(1))
    p = n.join(e, "graph_id", "left").withColumn("share", 1 - F.coalesce("_e", F.lit(0)) / pairs)
    tries = F.when(F.col("share") <= high, F.lit(int(1.5 * wanted))).otherwise(F.floor(wanted / F.col("share")))
    return p.select("graph_id", "share", F.when(F.col("share") < low, "dense").otherwise("sparse").alias("method"), F.when(F.col("share") < low, F.col("_n") * (F.col("_n") - 1)).otherwise(tries).cast("long").alias("tries"))


def chosen_negative_edges(nodes: DataFrame, edges: DataFrame, per_graph: int, seed: int = 0) -> DataFrame:
    """Pairs that are no edges: all pairs are listed in graphs that are mostly edges, and guessed in the others."""
    dense = sampling_plan(nodes, edges, per_graph).where("method = 'dense'").select("graph_id")
    listed = negative_edges(nodes.join(dense, "graph_id", "left_semi"), edges, per_graph, "hash", seed)
    rest = nodes.join(dense, "graph_id", "left_anti")
    guessed = sampled_negative_edges(rest, edges, per_graph, seed)
    few = ranked(guessed, ["graph_id"], [F.xxhash64(F.lit(seed), "src", "dst"), F.col("src"), F.col("dst")], "_r", spread=True).where(F.col("_r") < per_graph)
    return listed.unionByName(few.select("graph_id", "src", "dst"))


def sampled_negative_edges(nodes: DataFrame, edges: DataFrame, per_node: int, seed: int = 0) -> DataFrame:
    """About ``per_node`` hashed guesses for each node, without edges, loops and repeats: linear in the nodes."""
    numbered = ranked(nodes.select("graph_id", "node_id"), ["graph_id"], [F.col("node_id")], "_i", spread=True)
    size = numbered.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    guess = numbered.join(size, "graph_id").withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(per_node)))).select("graph_id", F.col("node_id").alias("src"), F.pmod(F.xxhash64(F.lit(seed), "graph_id", "node_id", "_t"), F.col("_n")).alias("_i"))
    found = guess.join(numbered.select("graph_id", "_i", F.col("node_id").alias("dst")), ["graph_id", "_i"]).where("src <> dst").select("graph_id", "src", "dst").distinct()
    return found.join(edges, ["graph_id", "src", "dst"], "left_anti")


def bipartite_negative_edges(left: DataFrame, right: DataFrame, edges: DataFrame, per_left: int) -> DataFrame:
    """For each left node, its first ``per_left`` right nodes in id order without an edge.

    A left node with d edges finds them among the first d + per_left right nodes, so no product of the sides is made.
    """
    r = ranked(right.select(F.col("node_id").alias("dst")).withColumn("_g", F.lit(0)), ["_g"], [F.col("dst")], "_i", spread=True).select("dst", "_i")
    d = left.select(F.col("node_id").alias("src")).join(edges.groupBy("src").agg(F.countDistinct("dst").alias("_d")), "src", "left").na.fill({"_d": 0})
    tries = d.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_d") + per_left - 1))).join(r, "_i").select("src", "dst")
    return ranked(tries.join(edges, ["src", "dst"], "left_anti"), ["src"], [F.col("dst")], "_r").where(F.col("_r") < per_left).select("src", "dst")
