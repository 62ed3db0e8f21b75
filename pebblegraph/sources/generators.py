"""Synthetic graphs, text files and mini-batches."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.fixpoint import ranked


def _both(e: DataFrame) -> DataFrame:
    e = e.where("src <> dst").select(F.lit(0).cast("long").alias("graph_id"), "src", "dst")
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e.select("graph_id", F.inline(ends)).distinct().withColumn("weight", F.lit(1.0))


def _nodes(spark: SparkSession, n: int, *x) -> DataFrame:
    i = spark.range(n).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("node_id"))
    return i.withColumn("x", F.array(*(c.cast("double") for c in (x or (F.col("node_id"),)))))


def path(spark: SparkSession, n: int) -> Graph:
    return Graph(_nodes(spark, n), _both(spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))))


def ring(spark: SparkSession, n: int) -> Graph:
    return Graph(_nodes(spark, n), _both(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))))


def grid(spark: SparkSession, rows: int, cols: int, wrap: bool = False) -> Graph:
    """A grid, or a torus."""
    i = spark.range(rows * cols).select("id", F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    right = i.where(F.lit(wrap) | (F.col("c") < cols - 1)).select(F.col("id").alias("src"), (F.col("r") * cols + (F.col("c") + 1) % cols).alias("dst"))
    down = i.where(F.lit(wrap) | (F.col("r") < rows - 1)).select(F.col("id").alias("src"), ((F.col("r") + 1) % rows * cols + F.col("c")).alias("dst"))
    return Graph(_nodes(spark, rows * cols, F.floor(F.col("node_id") / cols), F.col("node_id") % cols), _both(right.union(down)))


def full(spark: SparkSession, n: int) -> Graph:
    return Graph(_nodes(spark, n), _both(spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst"))))


def random(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    """Each pair is an edge with probability p, by hash: the same graph however the pairs are dealt out."""
    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst")).where("src < dst")
    return Graph(_nodes(spark, n), _both(e.where(F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(1 << 30)) < int(p * (1 << 30)))))


def attached(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    """A tree: each node links to one before it, itself chosen by an edge's end (copying model), in log rounds of lookups."""
    i = spark.range(1, n).select(F.col("id").alias("src"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("id")).alias("pick"), (F.xxhash64(F.lit(seed + 1), "id") % 2 == 0).alias("copy"))
    to = i.alias("a").join(i.alias("b"), F.col("a.pick") == F.col("b.src"), "left").select(F.col("a.src").alias("src"), F.when(F.col("a.copy") & F.col("b.pick").isNotNull(), F.col("b.pick")).otherwise(F.col("a.pick")).alias("dst"))
    return Graph(_nodes(spark, n), _both(to))


def gset(spark: SparkSession, file: str, dims: int = 32, seed: int = 0, directed: bool = False) -> Graph:
    """A text file of lines "u v w", ids from 1; other lines (the header "n m") only say how many nodes there are."""
    parts = spark.read.text(file).select(F.split(F.trim("value"), r"\s+").alias("p"))
    e = parts.where(F.size("p") == 3).select(F.lit(0).cast("long").alias("graph_id"), (F.col("p")[0].cast("long") - 1).alias("src"), (F.col("p")[1].cast("long") - 1).alias("dst"), F.col("p")[2].cast("double").alias("weight"))
    if not directed:
        e = e.union(e.select("graph_id", F.col("dst"), F.col("src"), "weight")).groupBy("graph_id", "src", "dst").agg(F.max("weight").alias("weight"))
    head = parts.where(F.size("p") == 2).agg(F.max(F.col("p")[0].cast("long"))).first()[0] or 0
    n = spark.range(head).select(F.lit(0).cast("long").alias("graph_id"), F.col("id").alias("node_id"), F.array(*(F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(j)), F.lit(1 << 20)) / (1 << 20) for j in range(dims))).alias("x"))
    return Graph(n, e)


def classification_bench(spark: SparkSession, file: str, split: str = "tr") -> tuple[Graph, DataFrame]:
    """Graphs and labels (graph_id, y) of a .npz with lists {split}_feat, {split}_adj, {split}_class (one-hot)."""
    raw = spark.read.format("binaryFile").load(file).select("content")

    def run(batches):
        for b in batches:
            for content in b["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=True)
                for g, (x, a, y) in enumerate(zip(z[f"{split}_feat"], z[f"{split}_adj"], z[f"{split}_class"])):
                    i, j = np.nonzero(a)
                    yield pd.DataFrame({"graph_id": [g], "y": [int(np.argmax(y))], "x": [np.asarray(x, float).tolist()], "src": [i.tolist()], "dst": [j.tolist()], "weight": [np.asarray(a, float)[i, j].tolist()]})

    rows = raw.mapInPandas(run, "graph_id long, y long, x array<array<double>>, src array<long>, dst array<long>, weight array<double>").persist()
    n = rows.select("graph_id", F.posexplode("x").alias("node_id", "x")).withColumn("node_id", F.col("node_id").cast("long"))
    e = rows.select("graph_id", F.inline(F.arrays_zip("src", "dst", "weight")))
    return Graph(n, e), rows.select("graph_id", "y")


def edge_probabilities(dbar: float, lam: float, n: int) -> tuple[float, float]:
    """(within, between) of a block model of mean degree dbar over n nodes."""
    inside, outside = (dbar + lam * dbar**0.5) / n, (dbar - lam * dbar**0.5) / n
    if not (0 <= inside <= 1 and 0 <= outside <= 1):
        raise ValueError("these parameters give no probabilities")
    return inside, outside


def _connected(a: np.ndarray) -> bool:
    seen = np.zeros(len(a), bool)
    seen[0] = True
    while True:
        more = seen | a[seen].any(axis=0)
        if (more == seen).all():
            return bool(seen.all())
        seen = more


def csbm(spark: SparkSession, graphs: int = 1024, per_class: int = 50, dbar: float = 10, lam: float = 1, gamma: float = 4, mu: float = 4, structured: float = 0.5, features: int = 4, seed: int = 80, attempts: int = 128) -> tuple[Graph, DataFrame]:
    """Graphs and labels: connected two-block models (1), and connected random graphs of the same degrees (0)."""
    n = 2 * per_class
    inside, outside = edge_probabilities(dbar, lam, n)

    def one(g: int) -> tuple[np.ndarray, np.ndarray, int]:
        r, side = np.random.default_rng([seed, g]), np.repeat([1, -1], per_class)
        for _ in range(attempts):
            a = np.triu(r.random((n, n)) < np.where(side[:, None] == side[None, :], inside, outside), 1)
            a = a | a.T
            if _connected(a):
                break
        else:
            raise RuntimeError(f"no connected two-block graph in {attempts} attempts")
        y = int(r.random() < structured)
        if not y:  # swaps of edge pairs keep the degrees and lose the blocks
            for _ in range(attempts):
                b, e = a.copy(), [tuple(p) for p in np.argwhere(np.triu(a))]
                for _ in range(10 * len(e)):
                    i, j = r.integers(len(e), size=2)
                    (u, v), (s, t) = e[i], e[j]
                    if len({u, v, s, t}) == 4 and not b[u, t] and not b[s, v]:
                        b[u, v] = b[v, u] = b[s, t] = b[t, s] = False
                        b[u, t] = b[t, u] = b[s, v] = b[v, s] = True
                        e[i], e[j] = (u, t), (s, v)
                if _connected(b):
                    a = b
                    break
            else:
                raise RuntimeError(f"no connected random graph of these degrees in {attempts} attempts")
        x = np.sqrt(mu / n) * side[:, None] * r.standard_normal(features)[None, :] / np.sqrt(features) * gamma + r.standard_normal((n, features)) / np.sqrt(features)
        return a, x, y

    def run(batches):
        for b in batches:
            for g in b["id"]:
                a, x, y = one(int(g))
                i, j = np.nonzero(a)
                yield pd.DataFrame({"graph_id": [g], "y": [y], "x": [x.tolist()], "src": [i.tolist()], "dst": [j.tolist()]})

    rows = spark.range(graphs).mapInPandas(run, "graph_id long, y long, x array<array<double>>, src array<long>, dst array<long>")
    nodes = rows.select("graph_id", F.posexplode("x").alias("node_id", "x")).withColumn("node_id", F.col("node_id").cast("long"))
    edges = rows.select("graph_id", F.inline(F.arrays_zip("src", "dst"))).withColumn("weight", F.lit(1.0))
    return Graph(nodes, edges), rows.select("graph_id", "y")


def batches(nodes: DataFrame, size: int = 1, shuffle_seed: int | None = None) -> DataFrame:
    """graph_id, batch_id: mini-batches of ``size`` graphs in id order, or in a hashed one."""
    if size < 1:
        raise ValueError("a batch holds a graph at least")
    g = nodes.select("graph_id").distinct().withColumn("_all", F.lit(0))
    order = [F.col("graph_id")] if shuffle_seed is None else [F.xxhash64(F.lit(shuffle_seed), "graph_id"), F.col("graph_id")]
    return ranked(g, ["_all"], order, "_i", spread=True).select("graph_id", F.floor(F.col("_i") / size).cast("long").alias("batch_id"))


def processed(graph: Graph, path: str, pre_filter: DataFrame | None = None, pre_transform: Callable[[Graph], Graph] | None = None) -> Graph:
    """The graph after an optional filter (graph_ids to keep) and transform, written under ``path`` once and read from there."""
    spark = graph.nodes.sparkSession
    if pre_filter is not None:
        graph = Graph(graph.nodes.join(pre_filter, "graph_id", "left_semi"), graph.edges.join(pre_filter, "graph_id", "left_semi"))
    if pre_transform is not None:
        graph = pre_transform(graph)
    graph.nodes.write.mode("ignore").parquet(f"{path}/nodes")
    graph.edges.write.mode("ignore").parquet(f"{path}/edges")
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
