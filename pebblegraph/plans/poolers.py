"""Named compositions of select, reduce, connect and lift, and hierarchies of them."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import activation, dot, hashed_weights, segment_softmax
from ..graph import Graph, collated, width, w_or_1
from ..operators import connect, convolve, kernels, losses, ops, reduce, select
from ..operators.assignments import collated_assigns
from ..operators.lift import eigen_lifted, lifted
from .fixpoint import cut, stored


@dataclass
class Pooled:
    """A coarser graph, the assignment that made it, and its objectives (name -> one-row or per-graph table)."""

    nodes: DataFrame
    edges: DataFrame
    assign: DataFrame
    loss: dict[str, DataFrame] = field(default_factory=dict)
    extra: dict[str, DataFrame] = field(default_factory=dict)
    dims: int = 0

    @property
    def graph(self) -> Graph:
        return Graph(self.nodes, self.edges)

    def __iter__(self):
        return iter((self.nodes, self.edges, self.assign, self.loss))

    def lift(self, original: DataFrame, features: DataFrame | None = None, matrix: str = "transpose", op: str = "sum") -> DataFrame:
        """Features (the pooled ones, or others of the supernodes) on the original nodes."""
        if "theta" in self.extra:
            return eigen_lifted(features or self.nodes, self.extra["theta"], self.dims)
        return lifted(features or self.nodes, self.assign, original, self.dims, matrix, op)


def _hard(g: Graph, assign: DataFrame, dims: int, red: str = "sum", con: str | None = "sum", loss: dict | None = None, **post) -> Pooled:
    return Pooled(reduce.reduced(g.nodes, assign, red, dims), connect.sparse_connect(g.edges, assign, con, **post), assign, loss or {}, dims=dims)


def _soft(g: Graph, assign: DataFrame, dims: int, loss: dict | None = None, **post) -> Pooled:
    return Pooled(reduce.reduced(g.nodes, assign, "sum", dims), connect.dense_connect(g.edges, assign, **post), assign, loss or {}, dims=dims)


def _layers(dims: int, k: int, layers: list | None) -> list:
    return layers or [(hashed_weights(dims, k), None)]


def topk(g: Graph, ratio: float = 0.5, min_score: float | None = None, p: list[float] | None = None, act: str = "tanh", multiplier: float = 1.0, attn: DataFrame | None = None, spread: bool = False) -> Pooled:
    dims = width(g.nodes)
    s = attn or select.linear_score(g.nodes, p or [1.0] * dims, act if min_score is None else None)
    a = cut(select.topk(s, ratio, min_score, spread))
    out = _hard(g, a, dims, con=None)
    if multiplier != 1.0:
        out.nodes = out.nodes.withColumn("x", F.transform("x", lambda v: v * multiplier))
    return out


def sag(g: Graph, ratio: float = 0.5, w_self: list | None = None, w_near: list | None = None, gnn: Callable | None = None, act: str = "tanh", spread: bool = False) -> Pooled:
    """Scores from a graph convolution that does not look at edge weights."""
    dims = width(g.nodes)
    plain = g.edges.withColumn("weight", F.lit(None).cast("double"))
    scored = gnn(g.nodes, plain) if gnn else convolve.graph_conv(g.nodes, plain, w_self or [[1.0]] * dims, w_near or [[1.0]] * dims)
    a = select.topk(scored.select("graph_id", "node_id", activation(act)(F.col("x")[0]).alias("score")), ratio, spread=spread)
    return _hard(g, cut(a), dims, con=None)


def pan(g: Graph, ratio: float = 0.5, p: list[float] | None = None, beta: tuple[float, float] = (0.5, 0.5), spread: bool = False) -> Pooled:
    dims = width(g.nodes)
    d = ops.degree(g.nodes, g.edges)
    s = g.nodes.join(d, ["graph_id", "node_id"]).select("graph_id", "node_id", F.tanh(beta[0] * dot(F.col("x"), p or [1.0] * dims) + beta[1] * F.col("degree")).alias("score"))
    return _hard(g, cut(select.topk(s, ratio, spread=spread)), dims, con=None, self_loops=True)


def asap_features(g: Graph, dims: int, lin: list[list[float]] | None = None, att: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with attended features, edges with loops) of the cluster of each node and its in-neighbours."""
    e = cut(ops.add_remaining_self_loops(g.nodes, g.edges))
    lin = lin or [[float(i == j) for j in range(dims)] for i in range(dims)]
    att = att or [1.0 / dims] * (2 * dims)
    flat = g.nodes.select("graph_id", F.col("node_id").alias("src"), *(F.col("x")[i].alias(f"x{i}") for i in range(dims)))
    far = e.join(flat, ["graph_id", "src"])
    top = far.groupBy("graph_id", "dst").agg(*(F.max(f"x{i}").alias(f"m{i}") for i in range(dims)))
    q = top.select("graph_id", "dst", *(dot(F.array(*(f"m{i}" for i in range(dims))), [row[j] for row in lin]).alias(f"q{j}") for j in range(dims)))
    raw = far.join(q, ["graph_id", "dst"]).withColumn("_a", activation("leaky_relu")(dot(F.array(*(f"q{i}" for i in range(dims)), *(f"x{i}" for i in range(dims))), att)))
    soft = raw.withColumn("_s", segment_softmax(F.col("_a"), "graph_id", "dst"))
    return soft.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.array(*(F.sum(F.col("_s") * F.col(f"x{i}")) for i in range(dims))).alias("x")), e


def asap(g: Graph, ratio: float = 0.5, lin: list | None = None, att: list[float] | None = None, le: tuple | None = None, gnn: Callable | None = None, spread: bool = False) -> Pooled:
    """gnn(nodes, edges): features from message passing, before the clusters attend to them."""
    dims = width(g.nodes)
    x, e = asap_features(Graph(cut(gnn(g.nodes, g.edges)), g.edges) if gnn else g, dims, lin, att)
    x = cut(x)
    w1, w2, w3 = le or ([1.0 / dims] * dims,) * 3
    s = convolve.local_extremum(x, e, w1, w2, w3).withColumn("score", activation("sigmoid")(F.col("score")))
    return _hard(Graph(x, e), cut(select.topk(s, ratio, spread=spread)), dims, con=None)


def ec(g: Graph, p: list[float] | None = None, method: str = "softmax", add: float = 0.5, spread: bool = False, ties: str = "id") -> Pooled:
    g = Graph(g.nodes, cut(g.edges))  # scores and contraction read them several times
    dims = width(g.nodes)
    s = select.edge_scores(g.nodes, g.edges, p or [1.0 / dims] * (2 * dims), method, add)
    return _hard(g, cut(select.edge_contraction(g.nodes, s, spread, ties)), dims)


def kmis(g: Graph, order_k: int = 1, scorer: str = "degree", heuristic: str | None = "greedy", force_undirected: bool = False, red: str | None = "sum", spread: bool = False) -> Pooled:
    dims = width(g.nodes)
    a, m = select.kmis(g.nodes, g.edges, order_k, scorer, heuristic, force_undirected, spread)
    a = cut(a)
    out = _hard(g, a, dims, red or "sum")
    out.extra["mis"] = m
    if red is None:
        out.nodes = reduce.members_only(g.nodes, m, a, dims)
    return out


def graclus(g: Graph, spread: bool = False, ties: str = "id", symmetric: bool = False) -> Pooled:
    return _hard(g, stored(select.graclus(g.nodes, g.edges, spread, ties, symmetric)), width(g.nodes))


def ndp(g: Graph, threshold: float = 1e-2) -> Pooled:
    a, dims = cut(kernels.ndp(g.nodes, g.edges)), width(g.nodes)
    return Pooled(reduce.reduced(g.nodes, a, "sum", dims), kernels.kron(g.nodes, ops.undirected(g.edges), a, threshold), a, dims=dims)


def sep(g: Graph) -> Pooled:
    return _hard(g, cut(kernels.sep(g.nodes, g.edges)), width(g.nodes), degree_norm=True)


def maxcut(g: Graph, ratio: float = 0.5, layers: int = 2, delta: float = 2.0, max_iter: int = 5, net: dict | None = None, spread: bool = False) -> Pooled:
    """Scores by sign-alternating propagation with I - delta L_sym, top-k, nearest-kept assignment of the rest.

    net: the score network's weights (see maxcut_scores()); without it, ``layers`` propagations with tanh, and a sum.
    """
    dims = width(g.nodes)
    m = cut(ops.delta_gcn(g.nodes, g.edges, delta))
    eye = [[float(i == j) for j in range(dims)] for i in range(dims)]
    s = cut(select.maxcut_scores(g.nodes, m, net or {"layers": [(eye, None)] * layers}))
    kept = cut(select.topk(s, ratio, spread=spread))
    full = select.assign_all(g.nodes, g.edges, kept, max_iter, spread=spread)
    out = Pooled(reduce.reduced(g.nodes, kept, "sum", dims), connect.sparse_connect(g.edges, full, "sum", weight_norm=True), full, {"maxcut_loss": losses.maxcut(g.edges, s)}, dims=dims)
    out.extra["scores"] = s
    return out


def nopool(g: Graph) -> Pooled:
    return Pooled(g.nodes, g.edges, select.identity(g.nodes), dims=width(g.nodes))


def _dense(losses_of: Callable[[Graph, DataFrame], dict]) -> Callable:
    def run(g: Graph, k: int, layers: list | None = None, act: str = "relu", degree_norm: bool = True, weight_norm: bool = False) -> Pooled:
        dims = width(g.nodes)
        s = cut(select.mlp_select(g.nodes, _layers(dims, k, layers), act))
        return _soft(g, s, dims, losses_of(g, s), degree_norm=degree_norm, weight_norm=weight_norm)

    return run


def _mix(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    out = None
    for w, df in parts:
        one = df.select("graph_id", (F.col("loss") * w).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("graph_id").agg(F.sum("loss").alias("loss"))


mincut = _dense(lambda g, s: {"cut_loss": losses.mincut(g.edges, s), "ortho_loss": losses.orthogonality(s)})
diff = _dense(lambda g, s: {"link_loss": losses.link_prediction(g.edges, s), "entropy_loss": losses.entropy(s)})
dmon = _dense(lambda g, s: {"spectral_loss": losses.spectral(g.edges, s), "cluster_loss": losses.cluster_size(s), "ortho_loss": losses.orthogonality(s)})
jb = _dense(lambda g, s: {"balance_loss": losses.just_balance(s)})
acc = _dense(lambda g, s: {"total_variation_loss": losses.total_variation(g.edges, s), "balance_loss": losses.asymmetric_norm(s)})


def hosc(g: Graph, k: int, layers: list | None = None, act: str = "relu", alpha: float = 0.5, mu: float = 0.1, degree_norm: bool = True) -> Pooled:
    dims = width(g.nodes)
    s = cut(select.mlp_select(g.nodes, _layers(dims, k, layers), act))
    loss = {"hosc_loss": _mix([((1 - alpha) / k, losses.mincut(g.edges, s)), (alpha / k, losses.motif_mincut(g.edges, s))]), "ortho_loss": _mix([(mu, losses.hosc_orthogonality(s))])}
    return _soft(g, s, dims, loss, degree_norm=degree_norm)


def bnpool(g: Graph, k: int, layers: list | None = None, k_init: float = 1.0, seed: int | None = None, alpha: float = 1.0, eta: float = 1.0, k_mean: float = 10.0, k_variance: float = 1.0, negatives: DataFrame | None = None) -> Pooled:
    """Stick-breaking memberships; its objectives are reconstruction over edges and non-edges (``negatives``, or guessed ones),
    eta times the sticks' divergence from Beta(1, alpha), and the prior of the cluster matrix, the last two over those pairs."""
    dims = width(g.nodes)
    layers = layers or [(hashed_weights(dims, 2 * (k - 1)), None)]
    s = cut(select.dp_select(g.nodes, layers, "relu", seed))
    matrix = [[k_init if i == j else -k_init for j in range(k)] for i in range(k)]
    quality = cut(losses.sparse_bce(g.edges, ops.sampled_negative_edges(g.nodes, g.edges, 2) if negatives is None else negatives, s, matrix))
    kl = losses.kl_beta(select.dp_sticks(g.nodes, layers), 1.0, alpha).join(quality.select("graph_id", "n_edges"), "graph_id")
    prior = losses.k_prior(matrix, k_mean, k_variance)
    loss = {"quality": quality, "kl": kl.select("graph_id", (eta * F.col("loss") / F.col("n_edges")).alias("loss")), "K_prior": quality.select("graph_id", (F.lit(prior) / F.col("n_edges")).alias("loss"))}
    return _soft(g, s, dims, loss)


def lap(g: Graph, shortest_path_reg: bool = False) -> Pooled:
    dims = width(g.nodes)
    g = Graph(stored(g.nodes), stored(g.edges))  # leaders, memberships and connections read them several times
    lead = stored(select.lapool_leaders(g.nodes, g.edges, dims))
    far = kernels.hops(g.nodes, g.edges, lead.where("leader")) if shortest_path_reg else None
    return _soft(g, stored(select.lapool(g.nodes, g.edges, dims, far, lead)), dims)


def by_assignment(g: Graph, assign: DataFrame, red: str = "sum", con: str | None = "sum", soft: bool = False, **post) -> Pooled:
    """The other steps after a selection that is there already. soft: a node may have several memberships."""
    dims = width(g.nodes)
    return _soft(g, assign, dims, **post) if soft else _hard(g, assign, dims, red, con, **post)


def nmf(g: Graph, k: int) -> Pooled:
    return _soft(g, cut(kernels.nmf(g.nodes, g.edges, k)), width(g.nodes))


def eigen(g: Graph, k: int, num_modes: int = 5) -> Pooled:
    dims = width(g.nodes)
    theta = cut(kernels.eigen_theta(g.nodes, g.edges, k, num_modes))
    a = theta.where("mode = 0").select("graph_id", "node_id", "cluster_id", F.lit(1.0).alias("weight"))
    out = Pooled(reduce.eigen_reduced(g.nodes, theta, dims, num_modes), connect.external_connect(g.edges, a), a, dims=dims)
    out.extra["theta"] = theta
    return out


POOLERS: dict[str, Callable[..., Pooled]] = {f.__name__: f for f in (topk, sag, pan, asap, ec, kmis, graclus, ndp, sep, maxcut, nopool, hosc, bnpool, lap, nmf, eigen)} | {"mincut": mincut, "diff": diff, "dmon": dmon, "jb": jb, "acc": acc}
#: Name -> (sparse assignment, trainable, has objectives, may be precomputed).
ABILITIES: dict[str, tuple[bool, bool, bool, bool]] = {
    "topk": (True, True, False, False), "sag": (True, True, False, False), "pan": (True, True, False, False), "asap": (True, True, False, False), "ec": (True, True, False, False), "kmis": (True, False, False, True),
    "graclus": (True, False, False, True), "ndp": (True, False, False, True), "sep": (True, False, False, True), "maxcut": (True, True, True, False), "nopool": (True, False, False, True), "mincut": (False, True, True, False),
    "diff": (False, True, True, False), "dmon": (False, True, True, False), "hosc": (False, True, True, False), "jb": (False, True, True, False), "acc": (False, True, True, False), "bnpool": (False, True, True, False),
    "lap": (False, False, False, False), "nmf": (False, False, False, True), "eigen": (False, False, False, True),
}


def get_pooler(name: str, **options) -> Callable[[Graph], Pooled]:
    """A pooler by name; a suffix _u (flat batches) makes no difference here. Options that it does not have are ignored."""
    key = name.lower().removesuffix("_u")
    if key not in POOLERS:
        raise ValueError(f"no pooler {name}; there are {', '.join(POOLERS)}")
    f = POOLERS[key]
    params = inspect.signature(f).parameters
    if lost := [p for p, v in params.items() if p != "g" and v.default is inspect.Parameter.empty and p not in options]:
        raise TypeError(f"{key} needs {', '.join(lost)}")
    chosen = {k: v for k, v in options.items() if k in params}
    return lambda g: f(g, **chosen)


def abilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *v) for n, v in ABILITIES.items()], "name string, sparse boolean, trainable boolean, objectives boolean, precomputed boolean")


class Cached:
    """A pooler that keeps what it made of its first graph, until clear()."""

    def __init__(self, pooler: Callable[[Graph], Pooled]) -> None:
        self.pooler, self.kept = pooler, None

    def __call__(self, g: Graph) -> Pooled:
        if self.kept is None:
            p = self.pooler(g)
            p.nodes, p.edges, p.assign = cut(p.nodes), cut(p.edges), cut(p.assign)
            self.kept = p
        return self.kept

    def clear(self) -> None:
        self.kept = None


def _levels(steps: str | tuple | dict | Callable | list) -> list[tuple]:
    """(name or callable, options) of each level."""
    one = lambda s: (s, {}) if isinstance(s, str) or callable(s) else (s["name"], {k: v for k, v in s.items() if k != "name"}) if isinstance(s, dict) else (s[0], dict(s[1] or {}))
    return [one(s) for s in ([steps] if isinstance(steps, (str, tuple, dict)) or callable(steps) else steps)]


def runs(steps: str | tuple | dict | Callable | list) -> list[tuple]:
    """(name or callable, options, levels): equal levels in a row are one run."""
    out: list[tuple] = []
    for what, options in _levels(steps):
        if out and out[-1][0] == what and out[-1][1] == options:
            out[-1] = (what, options, out[-1][2] + 1)
        else:
            out.append((what, options, 1))
    return out


def _sep_run(g: Graph, levels: int) -> list[Pooled]:
    """All levels of one coding tree."""
    tree, out = cut(kernels.sep_levels(g.nodes, g.edges, levels)), []
    for k in range(levels):
        a = tree.where(F.col("level") == k).select("graph_id", F.col("child").alias("node_id"), F.col("parent").alias("cluster_id"), F.lit(1.0).alias("weight"))
        p = by_assignment(g, a, degree_norm=True)
        p.nodes, p.edges = cut(p.nodes), cut(p.edges)
        out.append(p)
        g = p.graph
    return out


def precoarsened(g: Graph, steps: str | tuple | dict | Callable | list) -> list[Pooled]:
    """One level after the other. steps: names, (name, options), dicts with "name", or functions of a graph.

    Trainable poolers are refused by name. Equal levels in a row are one run: those of sep come from one tree, the others are
    made one by one.
    """
    out = []
    for what, options, levels in runs(steps):
        if not callable(what) and not ABILITIES.get(what.lower(), (0, 0, 0, False))[3]:
            raise ValueError(f"{what} cannot be precomputed")
        if not callable(what) and what.lower() == "sep" and levels > 1:
            out += _sep_run(g, levels)
        else:
            for _ in range(levels):
                p = what(g) if callable(what) else get_pooler(what, **options)(g)
                p.nodes, p.edges = cut(p.nodes), cut(p.edges)
                out.append(p)
                g = p.graph
        g = out[-1].graph
    return out


def collated_levels(hierarchies: list[list[Pooled]]) -> list[Pooled]:
    """Hierarchies of several graphs as one, level by level; they must have equally many levels."""
    if len({len(h) for h in hierarchies}) != 1:
        raise ValueError("hierarchies of different numbers of levels")
    out = []
    for level in zip(*hierarchies):
        g = collated([p.graph for p in level])
        out.append(Pooled(g.nodes, g.edges, collated_assigns([p.assign for p in level]), dims=level[0].dims))
    return out


def tagged(levels: list[Pooled], what: str) -> DataFrame:
    """The levels' nodes, edges or assign tables as one, with a column level."""
    out = None
    for k, p in enumerate(levels):
        one = getattr(p, what).withColumn("level", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def volume(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id").agg(F.sum(w_or_1()).alias("volume"))
