"""Per-graph NumPy kernels: eigenvectors, solves and inherently sequential trees. One graph fits in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import w_or_1

ASSIGN = "graph_id long, node_id long, cluster_id long, weight double"
#: Nodes of a graph that a task may hold as a dense matrix (0.8 GB).
LARGEST = 10_000
#: Distances that are handed over at once.
ROWS = 50_000


def _fits(key: tuple, n: int) -> None:
    if n > LARGEST:
        raise ValueError(f"graph {key[0]} has {n} nodes; this kernel holds a dense matrix of {LARGEST} at most: use an operator made of joins (kmis, graclus, topk, eliminated)")


def _per_graph(nodes: DataFrame, edges: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(ids, adjacency) -> columns of the schema after graph_id, for each graph."""
    names = [c.split()[0] for c in schema.split(", ")]

    def kernel(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(n["node_id"].to_numpy().astype(np.int64))
        if not len(ids):
            return pd.DataFrame({c: [] for c in names})
        _fits(key, len(ids))
        a = np.zeros((len(ids), len(ids)))
        np.add.at(a, (np.searchsorted(ids, e["src"].to_numpy().astype(np.int64)), np.searchsorted(ids, e["dst"].to_numpy().astype(np.int64))), e["weight"].to_numpy().astype(float))
        cols = run(ids, a)
        size = max((len(c) for c in cols), default=0)
        return pd.DataFrame(dict(zip(names, [np.full(size, key[0]), *cols])))

    n, e = nodes.select("graph_id", "node_id"), edges.select(F.col("graph_id").alias("_g"), "src", "dst", w_or_1().alias("weight"))
    return n.groupBy("graph_id").cogroup(e.groupBy("_g")).applyInPandas(kernel, schema)


def laplacian(a: np.ndarray, normalized: bool = True) -> np.ndarray:
    """D - A, or I - D^-1/2 A D^-1/2; isolated nodes have zero rows in the first and a unit diagonal in the second."""
    d = a.sum(axis=0)
    if not normalized:
        return np.diag(d) - a
    r = 1 / np.sqrt(np.where(d > 0, d, 1.0)) * (d > 0)
    return np.eye(len(a)) - r[:, None] * a * r[None, :]


def ndp_split(a: np.ndarray, ids: np.ndarray, seed: int = 0) -> np.ndarray:
    """Kept nodes by the sign of the top eigenvector of the Laplacian, the first node's side; a hashed split if the cut is bad."""
    n = len(a)
    if n <= 1:
        return np.ones(n, bool)
    a = np.maximum(a, a.T)
    np.fill_diagonal(a, 0)
    _, v = np.linalg.eigh(laplacian(a))
    u = v[:, -1] * (1 if v[np.argmax(np.abs(v[:, -1]) > 1e-12), -1] >= 0 else -1)
    keep = u >= -1e-12
    z, volume = np.where(keep, 1.0, -1.0), a.sum()
    if volume and z @ laplacian(a, False) @ z / (2 * volume) >= 0.5 and keep.any() and not keep.all():
        return keep
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(63)
    keep = h == 1
    keep[0], keep[1] = True, False
    return keep


def ndp(nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """assign of kept nodes only, numbered by id."""

    def run(ids: np.ndarray, a: np.ndarray):
        kept = ids[ndp_split(a, ids, seed)]
        return kept, np.arange(len(kept)), np.ones(len(kept))

    return _per_graph(nodes, edges, run, ASSIGN)


def kron_matrix(a: np.ndarray, kept: np.ndarray, threshold: float = 1e-2) -> np.ndarray:
    """Adjacency of the Schur complement of the Laplacian on the kept nodes."""
    lap = np.diag(a.sum(axis=1)) - a
    k, g = np.nonzero(kept)[0], np.nonzero(~kept)[0]
    out = lap[np.ix_(k, k)]
    if len(g) and len(k):
        inner = lap[np.ix_(g, g)]
        try:
            x = np.linalg.solve(inner, lap[np.ix_(g, k)])
        except np.linalg.LinAlgError:
            x = np.linalg.solve(inner + 1e-6 * np.eye(len(g)), lap[np.ix_(g, k)])
        out = out - lap[np.ix_(k, g)] @ x
    if np.abs(out - out.T).sum() < 1e-9 * max(1e-300, np.abs(out).sum()):
        out = (out + out.T) / 2
    out = -out
    np.fill_diagonal(out, 0)
    out[np.abs(out) <= threshold] = 0
    return out


def kron(nodes: DataFrame, edges: DataFrame, kept: DataFrame, threshold: float = 1e-2) -> DataFrame:
    """Edges between kept nodes (an assign table) after the others are eliminated; ids are their clusters'."""
    flags = nodes.select("graph_id", "node_id").join(kept.select("graph_id", "node_id", "cluster_id"), ["graph_id", "node_id"], "left")

    def kernel(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("node_id")
        ids, cluster = n["node_id"].to_numpy().astype(np.int64), n["cluster_id"]
        _fits(key, len(ids))
        a = np.zeros((len(ids), len(ids)))
        np.add.at(a, (np.searchsorted(ids, e["src"].to_numpy().astype(np.int64)), np.searchsorted(ids, e["dst"].to_numpy().astype(np.int64))), e["weight"].to_numpy().astype(float))
        np.fill_diagonal(a, 0)
        keep = cluster.notna().to_numpy()
        if keep.sum() <= 1:
            return pd.DataFrame({"graph_id": [], "src": [], "dst": [], "weight": []})
        m = kron_matrix(a, keep, threshold)
        i, j = np.nonzero(m)
        label = cluster[keep].to_numpy().astype(np.int64)
        return pd.DataFrame({"graph_id": np.full(len(i), key[0]), "src": label[i], "dst": label[j], "weight": m[i, j]})

    e = edges.select(F.col("graph_id").alias("_g"), "src", "dst", w_or_1().alias("weight"))
    return flags.groupBy("graph_id").cogroup(e.groupBy("_g")).applyInPandas(kernel, "graph_id long, src long, dst long, weight double")


def factorised(a: np.ndarray, k: int, rounds: int = 500) -> np.ndarray:
    """Memberships: softmax of H' of A ~ W H, by multiplicative updates from a fixed start; trivial where k allows it."""
    n = len(a)
    if k >= n:
        return np.eye(n, k)
    if k == 1:
        return np.ones((n, 1))
    r = np.random.default_rng(0)
    w, h = r.random((n, k)) + 0.1, r.random((k, n)) + 0.1
    for _ in range(rounds):
        h *= (w.T @ a) / (w.T @ w @ h + 1e-10)
        w *= (a @ h.T) / (w @ h @ h.T + 1e-10)
    e = np.exp(h.T - h.T.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _soft(ids: np.ndarray, s: np.ndarray):
    n, k = s.shape
    return np.repeat(ids, k), np.tile(np.arange(k), n), s.ravel()


def nmf(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    return _per_graph(nodes, edges, lambda ids, a: _soft(ids, factorised(a, k)), ASSIGN)


def spectral_labels(a: np.ndarray, k: int) -> np.ndarray:
    """k-means on rows of the lowest eigenvectors of the Laplacian, from starts that are as far apart as can be."""
    n = len(a)
    k = max(1, min(k, n))
    if k == n:
        return np.arange(n)
    if k == 1:
        return np.zeros(n, int)
    _, v = np.linalg.eigh(laplacian(np.maximum(a, a.T)))
    x = v[:, :k] / np.maximum(np.linalg.norm(v[:, :k], axis=1, keepdims=True), 1e-12)
    centers = [x[0]]
    while len(centers) < k:
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(x[int(np.argmax(np.round(d, 9)))])
    c = np.array(centers)
    for _ in range(100):
        label = np.argmin(np.round(((x[:, None] - c[None]) ** 2).sum(axis=2), 9), axis=1)
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return np.unique(label, return_inverse=True)[1]


def eigen_select(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Hard spectral clusters."""

    def run(ids: np.ndarray, a: np.ndarray):
        return ids, spectral_labels(a, k), np.ones(len(ids))

    return _per_graph(nodes, edges, run, ASSIGN)


def pooling_matrix(a: np.ndarray, label: np.ndarray, modes: int, normalized: bool = True) -> np.ndarray:
    """(nodes, modes): for each node its cluster's eigenvectors, lowest first; the last one stands in for missing ones."""
    out = np.zeros((len(a), modes))
    for c in np.unique(label):
        rows = np.nonzero(label == c)[0]
        if len(rows) == 1:
            out[rows[0]] = a[rows[0], rows[0]]
            continue
        _, v = np.linalg.eigh(laplacian(a[np.ix_(rows, rows)], normalized))
        for m in range(modes):
            u = v[:, min(m, len(rows) - 1)]
            out[rows, m] = -u if u[0] < 0 else u
    return out


def eigen_theta(nodes: DataFrame, edges: DataFrame, k: int, modes: int = 5, normalized: bool = True) -> DataFrame:
    """graph_id, node_id, mode, cluster_id, value."""

    def run(ids: np.ndarray, a: np.ndarray):
        label = spectral_labels(a, k)
        t = pooling_matrix(a, label, modes, normalized)
        return np.repeat(ids, modes), np.tile(np.arange(modes), len(ids)).astype(np.int32), np.repeat(label, modes), t.ravel()

    return _per_graph(nodes, edges, run, "graph_id long, node_id long, mode int, cluster_id long, value double")


def pseudo_inverse(assign: DataFrame) -> DataFrame:
    """Rows of the transposed pseudo-inverse of a soft assignment; entries under 1e-5 are dropped."""

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, r = np.unique(pdf["node_id"], return_inverse=True)
        ks, c = np.unique(pdf["cluster_id"], return_inverse=True)
        s = np.zeros((len(ids), len(ks)))
        s[r, c] = pdf["weight"]
        p = np.linalg.pinv(s).T
        i, j = np.nonzero(np.abs(p) > 1e-5)
        return pd.DataFrame({"graph_id": np.full(len(i), key[0]), "node_id": ids[i], "cluster_id": ks[j], "weight": p[i, j]})

    return assign.select("graph_id", "node_id", "cluster_id", "weight").groupBy("graph_id").applyInPandas(kernel, ASSIGN)


# --- structural entropy ----------------------------------------------------------------------------------------------


class CodingTree:
    """A tree over the nodes that lowers structural entropy (Li and Pan 2016), of a fixed height.

    Greedy merges of the adjacent pair that gains most build a binary tree; the inner nodes whose removal costs least go,
    until the height is right. Ties go to the smaller ids.
    """

    def __init__(self, a: np.ndarray) -> None:
        self.a, self.n = a, len(a)
        self.volume = max(a.sum(), 1e-300)
        self.vol = dict(enumerate(a.sum(axis=1)))
        self.cut = dict(self.vol)
        self.children: dict[int, list[int]] = {i: [] for i in range(self.n)}
        self.parent: dict[int, int] = {}

    def build(self, height: int) -> int:
        """The root, after merging and squeezing to ``height`` levels of edges."""
        near = {i: {int(j): float(self.a[i, j]) for j in np.nonzero(self.a[i])[0] if j != i} for i in range(self.n)}
        top, new = set(range(self.n)), self.n
        pairs = [(self._gain(i, j, w), i, j, w) for i in near for j, w in near[i].items() if i < j]
        heapify(pairs)
        while len(top) > 1:
            while pairs and not {pairs[0][1], pairs[0][2]} <= top:
                heappop(pairs)  # one of the two has been merged since
            if not pairs:
                break
            _, i, j, w = heappop(pairs)
            self._join([i, j], new, self.cut[i] + self.cut[j] - 2 * w)
            merged: dict[int, float] = {}
            for old in (i, j):
                for k, v in near.pop(old).items():
                    near.get(k, {}).pop(old, None)
                    if k not in (i, j):
                        merged[k] = merged.get(k, 0.0) + v
            near[new] = merged
            for k, v in merged.items():
                near[k][new] = v
                heappush(pairs, (self._gain(k, new, v), k, new, v))
            top -= {i, j}
            top.add(new)
            new += 1
        if len(top) > 1 or not top:
            self._join(sorted(top), new, 0.0)
            root = new
        else:
            root = next(iter(top))
            if root < self.n:
                self._join([root], new, 0.0)
                root = new
        while self._height(root) > height:
            v = min((k for k in self._inner(root) if k != root), key=lambda k: (self.cut[k] * log2(max(self.vol[self.parent[k]], 1e-300) / max(self.vol[k], 1e-300)) if self.vol[k] > 0 else 0.0, k))
            p = self.parent[v]
            self.children[p] = [c for c in self.children[p] if c != v] + self.children.pop(v)
            for c in self.children[p]:
                self.parent[c] = p
            del self.parent[v]
        return root

    def _gain(self, i: int, j: int, w: float) -> float:
        vi, vj, gi, gj = self.vol[i], self.vol[j], self.cut[i], self.cut[j]
        vol = vi + vj
        term = lambda v, g, up: g * log2(v / up) if v > 0 else 0.0
        before = term(vi, gi, self.volume) + term(vj, gj, self.volume)
        after = term(vol, gi + gj - 2 * w, self.volume) + term(vi, gi, vol) + term(vj, gj, vol)
        return (before - after) / self.volume

    def _join(self, parts: list[int], new: int, cut: float) -> None:
        self.children[new] = list(parts)
        self.vol[new], self.cut[new] = sum(self.vol[p] for p in parts), cut
        for p in parts:
            self.parent[p] = new

    def _inner(self, root: int) -> list[int]:
        out, todo = [], [root]
        while todo:
            k = todo.pop()
            if self.children.get(k):
                out.append(k)
                todo.extend(self.children[k])
        return out

    def _height(self, root: int) -> int:
        level, here = 0, [root]
        while here := [c for k in here for c in self.children.get(k, [])]:
            level += 1
        return level

    def entropy(self) -> float:
        return -sum(self.cut[k] / self.volume * log2(self.vol[k] / self.vol[p]) for k, p in self.parent.items() if self.vol[k] > 0)

    def levels(self, root: int, count: int) -> list[np.ndarray]:
        """For each of ``count`` levels, from fine to coarse, the label of every node: its ancestor that far from the leaves."""
        out = []
        chain = []
        for i in range(self.n):
            up, k = [], i
            while k != root:
                k = self.parent[k]
                up.append(k)
            chain.append(up)
        for level in range(1, count + 1):
            # an ancestor that is not the root; leaves that hang at the root are clusters of their own
            raw = [next((c for c in reversed(up[: len(up) - 1][: level]) if c != root), i) for i, up in enumerate(chain)]
            first: dict[int, int] = {}
            out.append(np.array([first.setdefault(r, len(first)) for r in raw]))
        return out


def _tree_levels(a: np.ndarray, levels: int) -> list[np.ndarray]:
    a = np.maximum(a, a.T)
    np.fill_diagonal(a, 0)
    if not a.any():
        return [np.arange(len(a))] * levels
    tree = CodingTree(a)
    return tree.levels(tree.build(levels + 1), levels)


def sep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hard clusters of a coding tree of height two."""

    def run(ids: np.ndarray, a: np.ndarray):
        return ids, _tree_levels(a, 1)[0], np.ones(len(ids))

    return _per_graph(nodes, edges, run, ASSIGN)


def sep_levels(nodes: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """graph_id, level, child, parent: one tree for all levels; children of level 0 are nodes, then clusters."""

    def run(ids: np.ndarray, a: np.ndarray):
        level, child, parent, below = [], [], [], ids
        for k, label in enumerate(_tree_levels(a, levels)):
            pairs = sorted(set(zip(below.tolist(), label.tolist())))
            level += [k] * len(pairs)
            child += [p[0] for p in pairs]
            parent += [p[1] for p in pairs]
            below = label
        return np.array(level, np.int32), np.array(child), np.array(parent)

    return _per_graph(nodes, edges, run, "graph_id long, level int, child long, parent long")


def _distances(graph_id: int | None, leaders: list[int], near: dict[int, list[int]]) -> list[tuple]:
    out = []
    for leader in leaders:
        seen, here, far = {leader: 0}, [leader], 0
        while here:
            far += 1
            here = [d for d in dict.fromkeys(d for s in here for d in near.get(s, [])) if d not in seen]
            seen.update(dict.fromkeys(here, far))
        out += [(graph_id, k, leader, h) for k, h in seen.items()]
    return out


def hops(nodes: DataFrame, edges: DataFrame, leaders: DataFrame) -> DataFrame:
    """graph_id, node_id, leader, hops: breadth-first distances to each leader within reach.

    Graphs come one after the other in sorted batches, a leader without ``dst`` before the edges, so that no table is made
    for each; a task holds one graph.
    """
    lead = leaders.join(nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi").select("graph_id", F.col("node_id").alias("src"), F.lit(None).cast("long").alias("dst"))
    rows = lead.unionByName(edges.where("dst is not null").select("graph_id", "src", "dst")).repartition("graph_id").sortWithinPartitions("graph_id", F.col("dst").asc_nulls_first(), "src")
    schema = pa.schema([(c, pa.int64()) for c in ("graph_id", "node_id", "leader", "hops")])

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, found, near, out = None, [], False, {}, []
        for b in batches:
            for g, s, d in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not found or g != current:
                    out += _distances(current, first, near)
                    current, first, found, near = g, [], True, {}
                    if len(out) >= ROWS:
                        yield told(out)
                        out = []
                if d is None:
                    first.append(s)
                else:
                    near.setdefault(s, []).append(d)
        out += _distances(current, first, near)
        if out:
            yield told(out)

    return rows.mapInArrow(run, "graph_id long, node_id long, leader long, hops long")
