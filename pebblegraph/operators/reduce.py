"""REDUCE: features of supernodes, and readouts of whole graphs."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import activation, dot
from ..graph import width

#: name -> column of one feature -> aggregate. Groups without rows are filled with 0 by the callers.
SIMPLE: dict[str, Callable[..., Column]] = {
    "sum": lambda c: F.sum(c),
    "mean": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "mul": lambda c: F.product(c),
    "var": lambda c: F.var_pop(c),
    "std": lambda c: F.stddev_pop(c),
    "power_mean": lambda c, p=1.0: F.pow(F.avg(F.pow(c, F.lit(float(p)))), F.lit(1.0 / p)),
    "quantile": lambda c, q=0.5: F.percentile(c, F.lit(float(q))),
    "variance_preserving": lambda c: F.sum(c) / F.sqrt(F.count(c)),
}
#: The lower median: the middle one, or the lower of the middle two. Counts of distinct values are merged, no list is made.
SIMPLE["median"] = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{c}`)")
ALIASES = {"add": "sum", "average": "mean", "minimum": "min", "maximum": "max", "prod": "mul", "product": "mul", "variance": "var", "standarddeviation": "std", "powermean": "power_mean", "variancepreserving": "variance_preserving", "degreescaler": "degree_scaler", "deepsets": "deep_sets", "multiaggregation": "multi", "aggr": "sum"}
OTHER = ("softmax", "sort", "degree_scaler", "multi", "deep_sets", "mlp", "attentional", "lstm", "gru", "set2set")


def _of(name: str, column: str, **options) -> Column:
    return SIMPLE[name](column if name == "median" else F.col(column), **options)


def resolve(alias: str) -> str:
    """The name that an alias stands for; case, spaces, dashes and a trailing word "aggregation" do not matter."""
    key = re.sub(r"[\s_-]", "", alias.lower()).removesuffix("aggregation")
    names = {re.sub("_", "", n): n for n in [*SIMPLE, *OTHER]}
    name = names.get(key) or ALIASES.get(key)
    if not name:
        raise ValueError(f"no aggregator {alias}; there are {', '.join([*SIMPLE, *OTHER])}")
    return name


def _weighted(nodes: DataFrame, assign: DataFrame, dims: int) -> DataFrame:
    n = nodes.select("graph_id", "node_id", *(F.col("x")[i].alias(f"x{i}") for i in range(dims)))
    return n.join(assign, ["graph_id", "node_id"]).select("graph_id", "node_id", "cluster_id", *((F.col("weight") * F.col(f"x{i}")).alias(f"x{i}") for i in range(dims)))


def aggregated(rows: DataFrame, keys: list[str], dims: int, op: str | Callable[..., DataFrame] = "sum", **options) -> DataFrame:
    """keys, x of rows with columns x0.. and node_id. op: a name, or the caller's own function of (rows, keys, dims)."""
    if callable(op):
        return op(rows, keys, dims, **options)
    name, cols = resolve(op), [f"x{i}" for i in range(dims)]
    if name in SIMPLE:
        return rows.groupBy(*keys).agg(F.array(*(_of(name, c, **options) for c in cols)).alias("x"))
    if name == "softmax":
        t = options.get("t", 1.0)
        scaled = rows.join(rows.groupBy(*keys).agg(*(F.max(t * F.col(c)).alias(f"_m{i}") for i, c in enumerate(cols))), keys)
        e = [F.exp(t * F.col(c) - F.col(f"_m{i}")) for i, c in enumerate(cols)]
        return scaled.groupBy(*keys).agg(F.array(*(F.sum(F.col(c) * v) / F.sum(v) for c, v in zip(cols, e))).alias("x"))
    if name == "sort":
        k = options.get("k", 2)
        r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(cols[-1]).desc(), "node_id"))).where(F.col("_r") <= k)
        return r.groupBy(*keys).agg(F.array(*(F.coalesce(F.max(F.when(F.col("_r") == j, F.col(c))), F.lit(0.0)) for j in range(1, k + 1) for c in cols)).alias("x"))
    if name == "multi":
        ops = [resolve(o) for o in options.get("ops", ["sum", "mean", "max"])]
        return rows.groupBy(*keys).agg(F.array(*(_of(o, c) for o in ops for c in cols)).alias("x"))
    if name == "degree_scaler":
        ops, delta = [resolve(o) for o in options.get("ops", ["mean", "max"])], float(options.get("delta", 1.0))
        log = F.log(F.count(F.lit(1)) + 1.0)
        scale = {"identity": F.lit(1.0), "amplification": log / delta, "attenuation": delta / log, "linear": F.count(F.lit(1)) / delta, "inverse_linear": delta / F.count(F.lit(1))}
        return rows.groupBy(*keys).agg(F.array(*(_of(o, c) * scale[s] for s in options.get("scalers", ["identity", "amplification", "attenuation"]) for o in ops for c in cols)).alias("x"))
    if name in ("deep_sets", "mlp"):
        inner, outer, f = options["inner"], options["outer"], activation(options.get("act", "relu"))
        x = F.array(*cols)
        hidden = rows.select(*keys, *(f(dot(x, [row[j] for row in inner])).alias(f"h{j}") for j in range(len(inner[0]))))
        s = hidden.groupBy(*keys).agg(F.array(*(F.sum(f"h{j}") for j in range(len(inner[0])))).alias("h"))
        return s.select(*keys, F.array(*(dot(F.col("h"), [row[j] for row in outer]) for j in range(len(outer[0])))).alias("x"))
    if name == "attentional":
        g = rows.withColumn("_g", dot(F.array(*cols), options["gate"]))
        g = g.join(g.groupBy(*keys).agg(F.max("_g").alias("_m")), keys).withColumn("_e", F.exp(F.col("_g") - F.col("_m")))
        return g.groupBy(*keys).agg(F.array(*(F.sum(F.col("_e") * F.col(c)) / F.sum("_e") for c in cols)).alias("x"))
    return _sequence(rows, keys, dims, name, **options)


def _sequence(rows: DataFrame, keys: list[str], dims: int, name: str, weights: dict | None = None, hidden: int | None = None, steps: int = 2) -> DataFrame:
    """Recurrent readers of a group's rows in node order, with the caller's weights (or fixed hashed ones)."""
    from ..functions.columns import hashed_weights

    h = hidden or dims
    gates = {"lstm": 4, "gru": 3, "set2set": 4}[name]
    ins = 2 * dims if name == "set2set" else dims
    out = dims if name == "set2set" else h
    w = weights or {"in": hashed_weights(ins, gates * out, 1), "own": hashed_weights(out, gates * out, 2)}
    wi, wo = np.array(w["in"]), np.array(w["own"])
    sig = lambda v: 1 / (1 + np.exp(-v))

    def cell(x, s, c):
        if name == "gru":
            a, b = x @ wi, s @ wo
            r, z = sig(a[..., :out] + b[..., :out]), sig(a[..., out : 2 * out] + b[..., out : 2 * out])
            return (1 - z) * np.tanh(a[..., 2 * out :] + r * b[..., 2 * out :]) + z * s, c
        i, f, g, o = np.split(x @ wi + s @ wo, 4, axis=-1)
        c = sig(f) * c + sig(i) * np.tanh(g)
        return sig(o) * np.tanh(c), c

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("node_id")[[f"x{i}" for i in range(dims)]].to_numpy()
        s, c = np.zeros(out), np.zeros(out)
        q = np.zeros(2 * dims)
        for _ in range(steps):
            s, c = cell(q, s, c)
            a = np.exp(x @ s - (x @ s).max())
            q = np.concatenate([s, (a / a.sum()) @ x])
        return pd.DataFrame([[*key, q.tolist()]], columns=[*keys, "x"])

    def read(batches):
        """Rows come group by group: a step takes the next row of every group of a batch, and the last group's state goes on."""
        last, s0, c0 = None, np.zeros(out), np.zeros(out)

        def told(keys_of: pa.Table, s: np.ndarray) -> pa.RecordBatch:
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, out), pa.int32()), pa.array(s.ravel(), pa.float64()))
            return pa.RecordBatch.from_arrays([*(keys_of.column(k) for k in keys), x], names=[*keys, "x"])

        for b in batches:
            if not b.num_rows:
                continue
            fresh = np.zeros(b.num_rows, bool)
            for i, k in enumerate(keys):
                v, null = pc.fill_null(b.column(k), 0).to_numpy(zero_copy_only=False), b.column(k).is_null().to_numpy(zero_copy_only=False)
                fresh[1:] |= (v[1:] != v[:-1]) | (null[1:] != null[:-1])
                fresh[0] |= last is None or last.column(k)[0].as_py() != b.column(k)[0].as_py()
            if fresh[0] and last is not None:
                yield told(last, s0[None])
            starts = np.flatnonzero(np.r_[True, fresh[1:]])
            size = np.diff(np.r_[starts, b.num_rows])
            x = np.stack([b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(dims)], axis=1)
            s, c = np.zeros((len(starts), out)), np.zeros((len(starts), out))
            if not fresh[0]:
                s[0], c[0] = s0, c0
            on = np.arange(len(starts))
            for t in range(size.max()):
                on = on[size[on] > t]
                s[on], c[on] = cell(x[starts[on] + t], s[on], c[on])
            if len(starts) > 1:
                yield told(b.take(pa.array(starts[:-1])), s[:-1])
            last, s0, c0 = b.slice(b.num_rows - 1, 1), s[-1], c[-1]
        if last is not None:
            yield told(last, s0[None])

    if name != "set2set":
        ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("node_id").asc_nulls_last())
        return ordered.select(*(F.col(k).cast("long").alias(k) for k in keys), *(F.col(f"x{i}").cast("double").alias(f"x{i}") for i in range(dims))).mapInArrow(read, ", ".join(f"{k} long" for k in keys) + ", x array<double>")
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} long" for k in keys) + ", x array<double>")


def reduced(nodes: DataFrame, assign: DataFrame, op: str = "sum", dims: int | None = None, **options) -> DataFrame:
    """nodes of the pooled graph: x of a supernode aggregates weight * x of its members."""
    dims = width(nodes) if dims is None else dims
    out = aggregated(_weighted(nodes, assign, dims), ["graph_id", "cluster_id"], dims, op, **options)
    return out.select("graph_id", F.col("cluster_id").alias("node_id"), "x")


def readout(nodes: DataFrame, op: str = "sum", graphs: DataFrame | None = None, dims: int | None = None, **options) -> DataFrame:
    """graph_id, x: one row a graph. graphs (graph_id): also those without nodes, as zeros."""
    dims = width(nodes) if dims is None else dims
    rows = nodes.select("graph_id", "node_id", *(F.col("x")[i].alias(f"x{i}") for i in range(dims)))
    out = aggregated(rows, ["graph_id"], dims, op, **options)
    if graphs is None:
        return out
    size = F.array_repeat(F.lit(0.0), dims)
    return graphs.select("graph_id").join(out, "graph_id", "left").select("graph_id", F.coalesce("x", size).alias("x"))


def batch_pooled(assign: DataFrame) -> DataFrame:
    """graph_id of every supernode."""
    return assign.select("graph_id", "cluster_id").distinct()


def members_only(nodes: DataFrame, members: DataFrame, assign: DataFrame, dims: int) -> DataFrame:
    """Supernodes that take only their own member's features, times its score."""
    own = assign.join(members.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
    return reduced(nodes, own, "sum", dims)


def eigen_reduced(nodes: DataFrame, theta: DataFrame, dims: int, modes: int) -> DataFrame:
    """theta (graph_id, node_id, mode, cluster_id, value): x of a supernode is its modes' sums, mode by mode."""
    n = nodes.select("graph_id", "node_id", *(F.col("x")[i].alias(f"x{i}") for i in range(dims)))
    rows = theta.join(n, ["graph_id", "node_id"])
    cell = [F.sum(F.when(F.col("mode") == h, F.col("value") * F.col(f"x{i}")).otherwise(0.0)) for h in range(modes) for i in range(dims)]
    return rows.groupBy("graph_id", F.col("cluster_id").alias("node_id")).agg(F.array(*cell).alias("x"))
