"""Exact nearest neighbours by dot product, block against block."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; a task holds two blocks.
BLOCK = 8192
#: Queries that are compared at once.
STRIP = 256
DIGITS = 6


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray | None]]:
    """ids, rows with plain vectors, these vectors in double precision, and the others: row -> vector, None where it has nulls.

    Plain vectors are finite and as wide as the widest.
    """
    ids, col = table.column("node_id").to_numpy(), pa.concat_arrays(table.column("x").chunks)
    wide = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    whole = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(np.maximum(wide, 0)) - np.maximum(wide, 0)
    rows = np.flatnonzero((wide == wide.max()) & (wide > 0))
    x = whole[starts[rows][:, None] + np.arange(max(wide.max(), 0))] if len(rows) else np.zeros((0, 0))
    fine = (np.abs(x) < 1e100).all(axis=1)
    others = {int(i): None for i in np.setdiff1d(np.arange(len(ids)), rows[fine])}
    for i in others:
        v = col[i].as_py()
        others[i] = None if v is None or None in v else np.array(v, dtype=np.float64)
    return ids, rows[fine], x[fine], others


def _rounded(s: np.ndarray) -> np.ndarray:
    """Half up at DIGITS places of the shortest decimal form, as round() of Spark does."""
    y = s * 10.0**DIGITS
    out = np.rint(y) / 10.0**DIGITS
    for i in np.flatnonzero((np.abs(np.abs(y - np.floor(y)) - 0.5) < 1e-3) | (np.abs(y) > 2.0**50)):
        if np.isfinite(s[i]):
            out[i] = float(Decimal(repr(float(s[i]))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP)) if abs(s[i]) < 1e15 else s[i]
        else:
            out[i] = s[i]
    return out


def _best(q: np.ndarray, d: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best pairs of each q: rounded weights falling, NaN first, then ids rising."""
    r = _rounded(w)
    order = np.lexsort((d, -np.where(np.isnan(r), 0.0, r), ~np.isnan(r), q))
    q = q[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def _few(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that k + 1 copies with smaller ids go before; a query can take none of the rest."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    fresh = np.r_[True, (s[1:] != s[:-1]) | (i[1:] != i[:-1])]
    number = np.cumsum(fresh)
    return np.sort(order[number - number[np.searchsorted(s, s)] <= k])


def _strips(qi: np.ndarray, qx: np.ndarray, di: np.ndarray, dx: np.ndarray, k: int):
    """(query rows, data rows, dot products) of each strip's best pairs. Products are summed in order of the dimensions.

    A matrix product finds all pairs that can be among the k best after rounding; only those are summed in order.
    """
    take = _few(di, dx, k)
    di, dx, dims = di[take], dx[take], qx.shape[1]
    longest = np.sqrt((dx * dx).sum(axis=1).max())
    for a in range(0, len(qi), STRIP):
        x, ids = qx[a : a + STRIP], qi[a : a + STRIP]
        p = x @ dx.T
        p[ids[:, None] == di[None, :]] = -np.inf
        slack = 1.01 * 10.0**-DIGITS + 8 * dims * np.finfo(float).eps * np.sqrt((x * x).sum(axis=1)) * longest
        low = np.partition(p, p.shape[1] - k, axis=1)[:, p.shape[1] - k] if p.shape[1] > k else np.full(len(x), -np.inf)
        r, c = np.nonzero((p >= (low - slack)[:, None]) & (p > -np.inf))
        w = np.zeros(len(r))
        for j in range(dims):
            w += x[r, j] * dx[c, j]
        keep = _best(r, di[c], w, k)
        yield a + r[keep], take[c[keep]], w[keep]


def _one_by_one(qi: np.ndarray, queries: dict, di: np.ndarray, data: dict, k: int):
    """The same for vectors (row -> vector) of any kind, with a mask of null products; these go last."""
    at = np.array(list(data), int)
    for a, x in queries.items():
        c = at[di[at] != qi[a]]
        null = np.array([x is None or data[j] is None or len(data[j]) != len(x) for j in c], bool)
        full, empty = c[~null], c[null]
        w = np.zeros(len(full))
        if len(full):
            m = np.array([data[j] for j in full])
            with np.errstate(all="ignore"):
                for j in range(len(x)):
                    w = w + x[j] * m[:, j]
        keep = _best(np.zeros(len(full), int), di[full], w, k)
        more = empty[np.argsort(di[empty], kind="stable")[:k]]
        yield np.full(len(keep) + len(more), a), np.r_[full[keep], more], np.r_[w[keep], np.zeros(len(more))], np.r_[np.zeros(len(keep), bool), np.ones(len(more), bool)]


def best_dots(vectors: DataFrame, k: int) -> DataFrame:
    """graph_id, src, dst, weight: each vector's k best others of its graph by dot product, rounded; ties go to the smaller id.

    vectors: graph_id, node_id, x (floats or doubles). All pairs are compared: each graph is dealt into blocks by a hash, and
    a task meets two of them, so that it holds no graph.
    """
    v = vectors.where("graph_id is not null and node_id is not null").select("graph_id", "node_id", "x")
    size = v.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
    dealt = v.join(size, "graph_id").withColumn("_b", F.pmod(F.xxhash64("node_id"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = dealt.withColumn("_o", every).select("graph_id", F.col("_b").alias("_q"), F.col("_o").alias("_d"), "node_id", "x")
    right = dealt.withColumn("_o", every).select(F.col("graph_id").alias("graph_id"), F.col("_o").alias("_q"), F.col("_b").alias("_d"), F.col("node_id").alias("node_id"), F.col("x").alias("x"))

    def meet(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"graph_id": [], "src": [], "dst": [], "dot": []}
        if a.num_rows and b.num_rows:
            qi, qr, qx, qo = _matrix(a)
            di, dr, dx, do = _matrix(b)
            found, plain_q, plain_d = [], {}, {}
            if len(qr) and len(dr) and qx.shape[1] == dx.shape[1]:
                found.append((qr[r], dr[c], w, np.zeros(len(r), bool)) for r, c, w in _strips(qi[qr], qx, di[dr], dx, k))
            else:
                plain_d = dict(zip(dr.tolist(), dx))
            if do or plain_d:
                plain_q = dict(zip(qr.tolist(), qx))
            found.append(_one_by_one(qi, plain_q, di, do | plain_d, k))
            if qo:
                found.append(_one_by_one(qi, qo, di, do | dict(zip(dr.tolist(), dx)), k))
            for r, c, w, null in chain.from_iterable(found):
                out["src"].append(qi[r])
                out["dst"].append(di[c])
                out["dot"].append(pa.array(w, pa.float64(), mask=null))
        src = np.concatenate([np.zeros(0, np.int64), *out["src"]])
        dots = pa.chunked_array(out["dot"], pa.float64()).combine_chunks() if out["dot"] else pa.array([], pa.float64())
        return pa.table({"graph_id": pa.array(np.full(len(src), key[0].as_py()), pa.int64()), "src": pa.array(src, pa.int64()), "dst": pa.array(np.concatenate([np.zeros(0, np.int64), *out["dst"]]), pa.int64()), "dot": dots})

    by = ["graph_id", "_q", "_d"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "graph_id long, src long, dst long, dot double")
    e = met.select("graph_id", "src", "dst", F.round("dot", DIGITS).alias("weight"))
    r = F.row_number().over(Window.partitionBy("graph_id", "src").orderBy(F.col("weight").desc(), "dst"))
    return e.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")
