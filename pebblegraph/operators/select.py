"""SELECT: a table (graph_id, node_id, cluster_id, weight) that assigns nodes to supernodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import activation, affine, dot, mlp, segment_softmax, softmax, stick_breaking
from ..graph import w_or_1
from ..plans.fixpoint import cut, hashed, ranked, stored, unioned
from .convolve import weighted_sum
from .ops import degree, remove_self_loops, softmaxed, undirected

ASSIGN = "graph_id long, node_id long, cluster_id long, weight double"


def from_labels(labels: DataFrame, spread: bool = False) -> DataFrame:
    """assign from (graph_id, node_id, label): cluster ids are the ranks of the labels in their graph.

    A column ``weight`` of the labels is carried, else weights are 1. spread: see ranked().
    """
    weight = F.col("weight") if "weight" in labels.columns else F.lit(1.0).alias("weight")
    if spread:
        ids = ranked(labels.select("graph_id", "label").distinct(), ["graph_id"], [F.col("label")], "cluster_id", True)
        return labels.join(ids, ["graph_id", "label"]).select("graph_id", "node_id", "cluster_id", weight)
    rank = F.dense_rank().over(Window.partitionBy("graph_id").orderBy("label")).cast("long") - 1
    return labels.select("graph_id", "node_id", rank.alias("cluster_id"), weight)


def identity(nodes: DataFrame) -> DataFrame:
    """Each node is its own supernode."""
    return nodes.select("graph_id", "node_id", F.col("node_id").alias("cluster_id"), F.lit(1.0).alias("weight"))


def linear_score(nodes: DataFrame, p: list[float], act: str | Callable[[Column], Column] | None = "tanh") -> DataFrame:
    """graph_id, node_id, score = act(x . p / |p|)."""
    norm = sum(v * v for v in p) ** 0.5
    return nodes.select("graph_id", "node_id", activation(act)(dot(F.col("x"), [v / norm for v in p])).alias("score"))


def topk(scores: DataFrame, ratio: float | int | None = 0.5, min_score: float | None = None, spread: bool = False) -> DataFrame:
    """The best of each graph by score: ceil(ratio * n) of them, ``ratio`` itself if it is 1 or more.

    min_score: instead, those whose softmax within the graph exceeds it; a graph's best one always stays. Supernodes are
    numbered by rank. Ties go to the smaller id. spread: see ranked().
    """
    if ratio is None and min_score is None:
        raise ValueError("ratio or min_score is needed")
    if min_score is not None:
        s = softmaxed(scores, F.col("score"), ["graph_id"], "score") if spread else scores.withColumn("score", segment_softmax(F.col("score"), "graph_id"))
        r = ranked(s, ["graph_id"], [F.col("score").desc(), F.col("node_id")], "cluster_id", spread)
        return r.where((F.col("score") > min_score) | (F.col("cluster_id") == 0)).select("graph_id", "node_id", "cluster_id", F.col("score").alias("weight"))
    r = ranked(scores, ["graph_id"], [F.col("score").desc(), F.col("node_id")], "cluster_id", spread)
    size = hashed(r.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n")), "graph_id") if spread else scores.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    limit = F.ceil(F.lit(float(ratio)) * F.col("_n")) if ratio < 1 else F.lit(int(ratio))
    return r.join(size, "graph_id").where(F.col("cluster_id") < limit).select("graph_id", "node_id", "cluster_id", F.col("score").cast("double").alias("weight"))


# --- k-MIS -----------------------------------------------------------------------------------------------------------


def mis_scores(nodes: DataFrame, edges: DataFrame, scorer: str = "degree", p: list[float] | None = None, seed: int = 0) -> DataFrame:
    """graph_id, node_id, score by degree, constant, canonical (-id), random (hashed) or linear (sigmoid of x . p)."""
    if scorer == "degree":
        return degree(nodes, edges).withColumnRenamed("degree", "score")
    value = {"constant": lambda: F.lit(1.0), "canonical": lambda: -F.col("node_id").cast("double"), "random": lambda: F.pmod(F.xxhash64(F.lit(seed), "graph_id", "node_id"), F.lit(1 << 30)) / (1 << 30), "linear": lambda: activation("sigmoid")(dot(F.col("x"), p))}
    if scorer not in value:
        raise ValueError(f"no scorer {scorer}; there are degree, {', '.join(value)}")
    return nodes.select("graph_id", "node_id", value[scorer]().alias("score"))


def heuristic(scores: DataFrame, edges: DataFrame, order_k: int = 1, kind: str | None = "greedy") -> DataFrame:
    """score / k, where k is 1 (greedy) or the score (w-greedy) summed over order_k steps of in-neighbours.

    scores may bring the in-edges of each node as ``near``, which is the first step of greedy.
    """
    if kind is None:
        return scores
    if kind not in ("greedy", "w-greedy"):
        raise ValueError(f"no heuristic {kind}")
    told = kind == "greedy" and order_k > 0 and "near" in scores.columns
    k = scores.select("graph_id", "node_id", (1.0 + F.col("near") if told else F.lit(1.0) if kind == "greedy" else F.col("score")).alias("k"))
    for _ in range(order_k - told):
        got = edges.join(k.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum("k").alias("more"))
        k = k.join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", (F.col("k") + F.coalesce("more", F.lit(0.0))).alias("k"))
    return scores.join(k, ["graph_id", "node_id"]).select("graph_id", "node_id", (F.col("score") / F.col("k")).alias("score"))


def _least_around(ranks: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """graph_id, node_id, least: the least rank within ``steps`` in-edges, of (graph_id, node_id, rank or null)."""
    m = ranks.select("graph_id", "node_id", F.col("rank").alias("least"))
    for _ in range(steps):
        got = edges.join(m.where("least is not null").withColumnRenamed("node_id", "src"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.min("least").alias("got"))
        m = m.join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.least("least", "got").alias("least"))
    return m


def independent_set(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, order_k: int = 1) -> DataFrame:
    """graph_id, node_id, rank of a maximal set in which no two nodes are within order_k edges.

    ranks: graph_id, node_id, rank; lower ranks go first. Each round, the nodes that are the least within reach join, and
    all within reach of them are done. Nodes that are done still pass ranks on. The first step starts from live nodes alone
    and the last one ends at live nodes alone, so the edges of both shrink with the live nodes (those between, beyond
    two steps, do not), and a round costs what is left.
    """
    e = remove_self_loops(edges).select("graph_id", "src", "dst")
    live = stored(ranks.select("graph_id", "node_id", "rank"))
    first = e.join(live.withColumnRenamed("node_id", "src"), ["graph_id", "src"])
    if order_k == 1:
        first = first.join(live.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_semi")
    steps = [stored(first), *([e] * (order_k - 1))] if order_k else []
    found = []
    while not live.isEmpty():
        seen = live.select("graph_id", "node_id", F.col("rank").alias("least"))
        if steps:
            got = steps[0].groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.min("rank").alias("least"))
            seen = seen.unionByName(got).groupBy("graph_id", "node_id").agg(F.min("least").alias("least"))
        for more in steps[1:]:
            got = more.join(seen.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.min("least").alias("least"))
            seen = stored(seen).unionByName(got).groupBy("graph_id", "node_id").agg(F.min("least").alias("least"))
        won = stored(live.join(seen, ["graph_id", "node_id"]).where("rank = least").select("graph_id", "node_id", "rank"))
        if won.isEmpty():
            raise RuntimeError("no live node has the least rank within reach: a rank is null")
        found.append(won)
        cover = won.select("graph_id", "node_id")
        for more in steps:
            near = more.join(cover.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").select("graph_id", F.col("dst").alias("node_id"))
            cover = stored(cover.union(near).distinct())
        live = stored(live.join(cover, ["graph_id", "node_id"], "left_anti"))
        for i, end in {(0, "src"), (order_k - 1, "dst")} if steps else ():
            steps[i] = steps[i].join(live.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_semi")
        for i in {0, order_k - 1} if steps else ():
            steps[i] = stored(steps[i])
    return unioned(found, live)


def both_ways(half: DataFrame) -> DataFrame:
    """Each pair of an undirected graph in both directions."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return half.select("graph_id", F.inline(ways), "weight")


def oriented(half: DataFrame, ranks: DataFrame) -> DataFrame:
    """graph_id, src, dst, rank: each pair of an undirected graph once, from its end of lower rank, which is carried."""
    r = ranks.select("graph_id", "node_id", "rank")
    e = half.select("graph_id", "src", "dst")
    for end, name in (("src", "_a"), ("dst", "_b")):
        e = e.join(r.select("graph_id", F.col("node_id").alias(end), F.col("rank").alias(name)), ["graph_id", end])
    up = F.col("_a") < F.col("_b")
    return e.select("graph_id", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"), F.least("_a", "_b").alias("rank"))


def oriented_set(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """independent_set() with order_k 1 of an undirected graph, from oriented() pairs.

    A live node joins if no pair of live nodes ends at it. The nodes that it covers rank after it, so one direction will do.
    """
    live, e, found = stored(ranks.select("graph_id", "node_id", "rank")), pairs, []
    while not live.isEmpty():
        after = e.select("graph_id", F.col("dst").alias("node_id")).distinct()
        won = stored(live.join(after, ["graph_id", "node_id"], "left_anti"))
        if won.isEmpty():
            raise RuntimeError("no live node has the least rank within reach: ranks are not unique")
        found.append(won)
        near = e.join(won.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi")
        cover = stored(near.select("graph_id", F.col("dst").alias("node_id")).distinct())
        live = stored(live.join(won.select("graph_id", "node_id").union(cover), ["graph_id", "node_id"], "left_anti"))
        for end in ("dst", "src"):  # pairs from a node that joined end at one that is covered
            e = e.join(cover.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
        e = stored(e.select("graph_id", "src", "dst", "rank"))
    return unioned(found, live)


def kmis(nodes: DataFrame, edges: DataFrame, order_k: int = 1, scorer: str | DataFrame = "degree", score_heuristic: str | None = "greedy", force_undirected: bool = False, spread: bool = False, p: list[float] | None = None, symmetric: bool = False) -> tuple[DataFrame, DataFrame]:
    """(assign, members): each node joins the member of least rank within order_k edges; weights are the raw scores.

    symmetric: each edge has its reverse, of the same weight. With order_k 1, each pair is then kept once, from its lower rank.
    """
    e = remove_self_loops(undirected(edges) if force_undirected else edges)
    once = symmetric and order_k == 1
    if once:
        half = stored(e.where("src < dst").select("graph_id", "src", "dst", "weight"))
        e = both_ways(half)
    if scorer == "degree" and score_heuristic == "greedy":  # one look at the edges for both
        near = e.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum(w_or_1()).alias("d"), F.count(F.lit(1)).alias("near"))
        scores = nodes.select("graph_id", "node_id").join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("d", F.lit(0.0)).alias("score"), F.coalesce("near", F.lit(0)).alias("near"))
    else:
        scores = scorer if isinstance(scorer, DataFrame) else mis_scores(nodes, e, scorer, p)
    scores = stored(scores)
    r = stored(ranked(heuristic(scores, e, order_k, score_heuristic), ["graph_id"], [F.col("score").desc(), F.col("node_id")], "rank", spread))
    if once:
        pairs = stored(oriented(half, r))
        members = stored(oriented_set(pairs, r))
        # the least member around a node that is none ranks before it
        near = pairs.join(members.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi")
        seen = members.select("graph_id", "node_id", F.col("rank").alias("least")).union(near.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.min("rank").alias("least")))
    else:
        members = stored(independent_set(nodes, e, r, order_k))
        seen = _least_around(nodes.select("graph_id", "node_id").join(members, ["graph_id", "node_id"], "left"), e, order_k)
    ids = ranked(members, ["graph_id"], [F.col("node_id")], "cluster_id", spread).select("graph_id", F.col("rank").alias("least"), "cluster_id")
    return seen.join(ids, ["graph_id", "least"]).join(scores, ["graph_id", "node_id"]).select("graph_id", "node_id", "cluster_id", F.col("score").cast("double").alias("weight")), members


# --- matching --------------------------------------------------------------------------------------------------------


def matching(edges: DataFrame) -> DataFrame:
    """Edges (graph_id, src, dst, rank) of a maximal matching; an edge joins if its rank is the least at both ends.

    Ranks are unique in a graph. So an edge joins if two nodes name it as their least one (a loop: one), and the rounds'
    winners come from a table of nodes.
    """
    start = edges.select("graph_id", "src", "dst", "rank")
    live, found = start, []
    ends = F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("node_id"), (4 * F.col("rank") + 2).alias("v")))).otherwise(F.array(F.struct(F.col("src").alias("node_id"), (4 * F.col("rank")).alias("v")), F.struct(F.col("dst").alias("node_id"), (4 * F.col("rank") + 1).alias("v"))))
    while not live.isEmpty():
        least = live.select("graph_id", F.inline(ends)).groupBy("graph_id", "node_id").agg(F.min("v").alias("v")).withColumn("end", F.col("v") % 4)
        named = least.groupBy("graph_id", F.shiftright("v", 2).alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("end"), F.max(F.when(F.col("end") != 1, F.col("node_id"))).alias("src"), F.max(F.when(F.col("end") != 0, F.col("node_id"))).alias("dst"))
        won = stored(named.where("n = 2 or end = 2").select("graph_id", "src", "dst", "rank"))
        if won.isEmpty():
            raise RuntimeError("no edge has the least rank at both ends: ranks are not unique")
        found.append(won)
        used = stored(won.select("graph_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("n")))
        for end in ("src", "dst"):
            live = live.join(used.withColumnRenamed("n", end), ["graph_id", end], "left_anti")
        live = stored(live.select("graph_id", "src", "dst", "rank"))
    return unioned(found, start)


def matched_clusters(nodes: DataFrame, matched: DataFrame, scores: bool = False, spread: bool = False) -> DataFrame:
    """assign: the destination of a matched edge joins its source; ids are ranks of the labels in the graph."""
    to = matched.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("_to"), *([F.col("score")] if scores else []))
    if scores:
        back = matched.select("graph_id", F.col("src").alias("node_id"), F.col("score").alias("_own")).groupBy("graph_id", "node_id").agg(F.max("_own").alias("_own"))
        out = nodes.select("graph_id", "node_id").join(to, ["graph_id", "node_id"], "left").join(back, ["graph_id", "node_id"], "left")
        weight = F.coalesce("score", "_own", F.lit(1.0))
    else:
        out, weight = nodes.select("graph_id", "node_id").join(to, ["graph_id", "node_id"], "left"), F.lit(1.0)
    return from_labels(out.select("graph_id", "node_id", F.coalesce("_to", "node_id").alias("label"), weight.alias("weight")), spread)


def edge_scores(nodes: DataFrame, edges: DataFrame, p: list[float], method: str | Callable = "softmax", add: float = 0.5) -> DataFrame:
    """graph_id, src, dst, score = norm([x_src, x_dst] . p) + add; norm: softmax over dst, tanh, sigmoid, or a function."""
    n = nodes.select("graph_id", "node_id", "x")
    e = edges.select("graph_id", "src", "dst").join(n.select("graph_id", F.col("node_id").alias("src"), F.col("x").alias("xs")), ["graph_id", "src"]).join(n.select("graph_id", F.col("node_id").alias("dst"), F.col("x").alias("xd")), ["graph_id", "dst"])
    half = len(p) // 2
    e = e.withColumn("raw", dot(F.col("xs"), p[:half]) + dot(F.col("xd"), p[half:]))
    score = segment_softmax(F.col("raw"), "graph_id", "dst") if method == "softmax" else activation(method)(F.col("raw"))
    return e.select("graph_id", "src", "dst", (score + add).alias("score"))


def ranked_edges(edges: DataFrame, best: str, ties: str = "id", spread: bool = False) -> DataFrame:
    """Edges with their rank in the graph, from the best to the worst; equal ones by their ends, or by a hash of the pair.

    A matching's rounds follow the longest run of falling ranks along a path. Ends run along paths where many edges are equal,
    so the rounds grow with the graph; a hash keeps them to its logarithm.
    """
    if ties not in ("id", "hash"):
        raise ValueError(f"no tie rule {ties}; there are id and hash")
    if ties == "id":
        return ranked(edges, ["graph_id"], [F.col(best).desc(), F.col("src"), F.col("dst")], "rank", spread)
    pair = F.md5(F.concat_ws(":", F.least("src", "dst").cast("string"), F.greatest("src", "dst").cast("string")))
    # bytes compare as their hexadecimal digits do
    return ranked(edges, ["graph_id"], [F.col(best).desc(), F.col("_pair"), F.col("src")], "rank", spread, {"_pair": F.unhex(pair)})


def edge_contraction(nodes: DataFrame, scored: DataFrame, spread: bool = False, ties: str = "id") -> DataFrame:
    """Greedy matching of scored edges (graph_id, src, dst, score), the best first; pairs become supernodes. ties: see ranked_edges()."""
    r = cut(ranked_edges(scored, "score", ties, spread))
    won = matching(r).join(r.select("graph_id", "rank", "score"), ["graph_id", "rank"])
    return matched_clusters(nodes, won, scores=True, spread=spread)


def graclus(nodes: DataFrame, edges: DataFrame, spread: bool = False, ties: str = "id", symmetric: bool = False) -> DataFrame:
    """Heavy-edge matching, the heaviest first: a deterministic form of randomised greedy clustering. ties: see ranked_edges().

    symmetric: each edge has its reverse, of the same weight. With ties by hash, that from the larger end comes right after
    the other and joins nothing, so it is left out.
    """
    if symmetric and ties != "hash":
        raise ValueError("symmetric needs ties by hash")
    e = (edges.where("src < dst") if symmetric else remove_self_loops(edges)).select("graph_id", "src", "dst", w_or_1().alias("w"))
    r = ranked_edges(e, "w", ties, spread)
    return matched_clusters(nodes, matching(r if spread else stored(r)), spread=spread)


# --- propagation -----------------------------------------------------------------------------------------------------


def propagate_once(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, cluster_id of nodes without a cluster that have neighbours with one: the most frequent, then the least."""
    a = assigned.select("graph_id", "node_id", "cluster_id")
    votes = edges.select("graph_id", "src", "dst").join(a.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).join(a.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_anti")
    counted = votes.groupBy("graph_id", "dst", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster_id")).alias("b"))
    return best.select("graph_id", "node_id", "b.cluster_id")


def propagate(edges: DataFrame, kept: DataFrame, rounds: int) -> DataFrame:
    """graph_id, node_id, cluster_id of kept nodes and of all that ``rounds`` of propagate_once() reach.

    After each round only edges into nodes without a cluster stay, as no other can vote.
    """
    have, e, rest = stored(kept.select("graph_id", "node_id", "cluster_id")), edges.select("graph_id", "src", "dst"), None
    for k in range(rounds):
        more = stored(propagate_once(have, e))
        if more.isEmpty():
            break
        have = stored(have.unionByName(more))
        if k == rounds - 1:
            break
        ends = e.select("graph_id", F.col("dst").alias("node_id")).distinct() if rest is None else rest
        rest = stored(ends.join(have, ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id"))
        if rest.isEmpty():
            break
        e = stored(e.join(rest.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi"))
    return have


def assign_all(nodes: DataFrame, edges: DataFrame, kept: DataFrame, max_iter: int = 5, seed: int = 0, spread: bool = False) -> DataFrame:
    """Extend a partial selection (assign rows of kept nodes) to all nodes: rounds of propagate_once(), then a kept node of
    the graph by hash, or of any graph where it has none. Clusters keep the kept nodes' ids; weights are 1."""
    if max_iter <= 0:
        raise ValueError("max_iter must be positive")
    have = propagate(edges, kept, max_iter)
    rest = nodes.select("graph_id", "node_id").join(have, ["graph_id", "node_id"], "left_anti")
    numbered = ranked(kept.select("graph_id", "node_id", "cluster_id"), ["graph_id"], [F.col("node_id")], "_i", spread)
    size = numbered.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    pick = rest.join(size, "graph_id", "left").withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), "graph_id", "node_id"), F.col("_n")))
    found = pick.join(numbered.select("graph_id", "_i", "cluster_id"), ["graph_id", "_i"], "left")
    anywhere = kept.agg(F.min(F.struct("graph_id", "node_id", "cluster_id")).alias("_any"))
    out = found.join(F.broadcast(anywhere), how="left").select("graph_id", "node_id", F.coalesce("cluster_id", "_any.cluster_id").alias("cluster_id"))
    return have.unionByName(out).withColumn("weight", F.lit(1.0))


# --- soft assignments ------------------------------------------------------------------------------------------------


def _long(nodes: DataFrame, s: Column) -> DataFrame:
    return nodes.select("graph_id", "node_id", F.posexplode(s).alias("cluster_id", "weight")).select("graph_id", "node_id", F.col("cluster_id").cast("long").alias("cluster_id"), "weight")


def mlp_select(nodes: DataFrame, layers: list, act: str | Callable = "relu") -> DataFrame:
    """Soft memberships: softmax of an MLP of the features."""
    rows = nodes.withColumn("_l", mlp(F.col("x"), layers, act)).withColumn("_s", softmax(F.col("_l")))
    return _long(rows, F.col("_s"))


def dp_select(nodes: DataFrame, layers: list, act: str | Callable = "relu", seed: int | None = None) -> DataFrame:
    """Stick-breaking memberships; layers end in 2 (k - 1) outputs, alphas then betas.

    Fractions are the means a / (a + b) of their Beta laws; with a seed, a hashed sample by the Kumaraswamy form instead.
    """
    outs = len(layers[-1][0][0])
    k = outs // 2 + 1
    soft = activation("softplus")
    raw = nodes.withColumn("_l", mlp(F.col("x"), layers, act)).withColumn("_ab", F.transform("_l", lambda v: F.greatest(F.lit(1e-3), F.least(F.lit(1e3), soft(v)))))
    parts = []
    for j in range(k - 1):
        a, b = F.col("_ab")[j], F.col("_ab")[k - 1 + j]
        if seed is None:
            parts.append(a / (a + b))
        else:
            u = (F.pmod(F.xxhash64(F.lit(seed), "graph_id", "node_id", F.lit(j)), F.lit(1 << 30)) + 0.5) / (1 << 30)
            parts.append(F.pow(1 - F.pow(1 - u, 1 / b), 1 / a))
    rows = raw.withColumn("_v", F.array(*parts)).withColumn("_s", stick_breaking(F.col("_v"), k))
    return _long(rows, F.col("_s"))


def dp_sticks(nodes: DataFrame, layers: list, act: str | Callable = "relu") -> DataFrame:
    """graph_id, node_id, stick, a, b: the Beta laws that dp_select() breaks sticks by."""
    k = len(layers[-1][0][0]) // 2
    soft = activation("softplus")
    ab = nodes.withColumn("_l", mlp(F.col("x"), layers, act)).withColumn("_ab", F.transform("_l", lambda v: F.greatest(F.lit(1e-3), F.least(F.lit(1e3), soft(v)))))
    pairs = F.array(*(F.struct(F.lit(j).alias("stick"), F.col("_ab")[j].alias("a"), F.col("_ab")[k + j].alias("b")) for j in range(k)))
    return ab.select("graph_id", "node_id", F.inline(pairs))


def maxcut_scores(nodes: DataFrame, matrix: DataFrame, net: dict) -> DataFrame:
    """graph_id, node_id, score by a network of given weights over a propagation matrix (edges, as from delta_gcn()).

    net: initial (weights, bias), layers (a list of the same: propagate, then affine), mlp (likewise, affine only), final, and
    the activations mp_act (tanh), mlp_act (relu) and act (tanh). Parts that are left out are skipped; final sums, then.
    """
    x = nodes.select("graph_id", "node_id", "x")
    to = lambda t, layer, f: t.select("graph_id", "node_id", F.transform(affine(F.col("x"), *layer), activation(f)).alias("x"))
    if "initial" in net:
        x = to(x, net["initial"], None)
    for layer in net.get("layers", []):
        x = to(weighted_sum(x, matrix, len(layer[0])), layer, net.get("mp_act", "tanh"))
    for layer in net.get("mlp", []):
        x = to(x, layer, net.get("mlp_act", "relu"))
    last = affine(F.col("x"), *net["final"])[0] if "final" in net else F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return x.select("graph_id", "node_id", activation(net.get("act", "tanh"))(last).alias("score"))


def lapool_leaders(nodes: DataFrame, edges: DataFrame, dims: int) -> DataFrame:
    """graph_id, node_id, v = |(L x)_i|, leader: whether no neighbour has a larger v; all are, where none would be."""
    e = remove_self_loops(edges)
    x = [F.col("x")[i].alias(f"x{i}") for i in range(dims)]
    n = nodes.select("graph_id", F.col("node_id").alias("dst"), *x)
    near = e.join(n, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sum(w_or_1()).alias("_d"), *(F.sum(w_or_1() * F.col(f"x{i}")).alias(f"a{i}") for i in range(dims)))
    rows = nodes.select("graph_id", "node_id", *x).join(near, ["graph_id", "node_id"], "left")
    norm = sum((F.pow(F.coalesce(F.col("_d") * F.col(f"x{i}") - F.col(f"a{i}"), F.lit(0.0)), 2) for i in range(dims)), F.lit(0.0))
    v = rows.select("graph_id", "node_id", F.round(F.sqrt(norm), 9).alias("v"))
    top = e.join(v.select("graph_id", F.col("node_id").alias("dst"), "v"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.max("v").alias("_m"))
    lead = v.join(top, ["graph_id", "node_id"], "left").withColumn("_l", F.col("v") >= F.coalesce("_m", F.lit(float("-inf"))))
    some = lead.groupBy("graph_id").agg(F.max(F.col("_l").cast("int")).alias("_some"))
    return lead.join(some, "graph_id").select("graph_id", "node_id", "v", (F.col("_l") | (F.col("_some") == 0)).alias("leader"))


def lapool(nodes: DataFrame, edges: DataFrame, dims: int, hops: DataFrame | None = None, lead: DataFrame | None = None) -> DataFrame:
    """Soft memberships: softmax over the graph's leaders of cosine similarity; leaders belong to themselves.

    hops: (graph_id, node_id, leader, hops) divides each similarity by the distance, where it is 1 or more.
    lead: the rows of lapool_leaders(), where they are there already.
    """
    lead = cut(lapool_leaders(nodes, edges, dims)) if lead is None else lead
    ids = ranked(lead.where("leader"), ["graph_id"], [F.col("node_id")], "cluster_id").select("graph_id", F.col("node_id").alias("leader"), "cluster_id")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, b: a + b * b))
    n = nodes.select("graph_id", "node_id", "x")
    pairs = n.join(ids.join(n.select("graph_id", F.col("node_id").alias("leader"), F.col("x").alias("xl")), ["graph_id", "leader"]), "graph_id")
    cosine = F.aggregate(F.zip_with("x", "xl", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / F.greatest(norm(F.col("x")) * norm(F.col("xl")), F.lit(1e-8))
    pairs = pairs.select("graph_id", "node_id", "leader", "cluster_id", cosine.alias("c"))
    if hops is not None:
        pairs = pairs.join(hops, ["graph_id", "node_id", "leader"], "left").withColumn("c", F.col("c") / F.greatest(F.coalesce("hops", F.lit(1)), F.lit(1)))
    soft = pairs.withColumn("s", segment_softmax(F.col("c"), "graph_id", "node_id"))
    own = lead.select("graph_id", "node_id", F.col("leader").alias("_is"))
    return soft.join(own, ["graph_id", "node_id"]).select("graph_id", "node_id", "cluster_id", F.when(F.col("_is"), (F.col("node_id") == F.col("leader")).cast("double")).otherwise(F.col("s")).alias("weight"))
