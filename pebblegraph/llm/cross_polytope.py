"""Near-duplicate embeddings by cross-polytope hashing (Andoni et al. 2015), verified in double precision.

Vectors are hashed in several tables. In each, ``parts`` pseudo-random rotations (three rounds of sign flips and a fast
Hadamard transform) turn a unit vector, and the nearest vertex of the cross-polytope (the largest coordinate and its sign)
is one part of the bucket's key. Each vector is put into its own bucket and into the ``probes`` - 1 nearest others, where a
part's second-largest coordinate takes the place of its largest. Keys hold the label, so only equal labels meet.

A bucket's vectors are compared block by block; links leave as counts for each vector and a spanning forest, never as all
pairs. Two vectors may meet in many buckets; they count in the first bucket that both have, which each can tell from the
keys that the vectors carry. Equal vectors are one class before all this: a class of m copies gives each m - 1 links, and
m links to every vector linked to it. Buckets over ``chunk`` vectors are cut into chunks, each pair of chunks on its own.

With the defaults, at least 0.9 of the pairs at the limit are found; the README has the figures against brute force.

Nulls: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with nothing and
keep their row. Repeated rows count as vectors of their own. Vectors of another length than the longest are padded with
zeros. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .components import connected_components

COSINE = 0.98
TABLES, PARTS, PROBES = 4, 3, 3
CHUNK = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, width) / np.sqrt(width)


def bucket_keys(x: np.ndarray, tables: int = TABLES, parts: int = PARTS, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """(rows, tables, probes) keys of unit vectors; the first probe is the vector's own bucket."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = np.zeros((len(x), tables, probes), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        vertex, loss = [], []
        for p in range(parts):
            y = x
            for k in range(3):
                y = hadamard(y * np.random.default_rng([seed, t, p, k]).choice([-1.0, 1.0], width))
            size = np.abs(y)
            two = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[rows, two[:, 0]] < size[rows, two[:, 1]]
            two[swap] = two[swap][:, ::-1]
            vertex.append(np.stack([2 * two[:, j] + (y[rows, two[:, j]] < 0) for j in (0, 1)], axis=1))
            loss.append(size[rows, two[:, 0]] - size[rows, two[:, 1]])
        keys, costs = [], []
        for choice in range(1 << parts):  # which parts take their second vertex
            key, cost = np.zeros(len(x), np.int64), np.zeros(len(x))
            for p in range(parts):
                second = choice >> p & 1
                key = key * (2 * width) + vertex[p][:, second]
                cost = cost + loss[p] * second
            keys.append(key)
            costs.append(cost)
        order = np.argsort(np.stack(costs, axis=1), axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(np.stack(keys, axis=1), order, axis=1) * tables + t
    return out


def _units(vectors: list[list[float]], width: int) -> np.ndarray:
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_ROWS = "bucket long, u long, n long, keys array<long>, unit array<double>"


def _compared(cosine: float):
    """Within a chunk pair of a bucket: rows (kind 0: u has n more links; kind 1: u and v are linked)."""
    out = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        own = np.array(table["c"].to_pylist())
        i, j, bucket = table["i"][0].as_py(), table["j"][0].as_py(), table["bucket"][0].as_py()
        ids, weight = table["u"].to_numpy(), table["n"].to_numpy()
        keys = np.array(table["keys"].to_pylist(), np.int64)
        x = np.array(table["unit"].to_pylist())
        a, b = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        links, parent = np.zeros(len(ids), np.int64), list(range(len(ids)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        forest: list[tuple[int, int]] = []
        for lo in range(0, len(a), 512):
            part = a[lo : lo + 512]
            near = x[part] @ x[b].T >= cosine
            if i == j:
                near &= part[:, None] < b[None, :]
            p, q = np.nonzero(near)
            p, q = part[p], b[q]
            if not len(p):
                continue
            # the first key that both have; they count where that is this bucket
            kp, kq = keys[p], keys[q]
            first = np.full(len(p), np.iinfo(np.int64).max)
            for k in range(keys.shape[1]):
                both = (kq == kp[:, k : k + 1]).any(axis=1)
                first = np.minimum(first, np.where(both, kp[:, k], first))
            here = first == bucket
            p, q = p[here], q[here]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            for s, t in zip(p.tolist(), q.tolist()):
                s, t = root(s), root(t)
                if s != t:
                    parent[s] = t
                    forest.append((s, t))
        some = np.nonzero(links)[0]
        kind = np.concatenate([np.zeros(len(some)), np.ones(len(forest))]).astype(np.int32)
        u = np.concatenate([ids[some], ids[[s for s, _ in forest]]]) if len(some) or forest else np.zeros(0, np.int64)
        v = np.concatenate([links[some], ids[[t for _, t in forest]]]) if len(some) or forest else np.zeros(0, np.int64)
        return pa.table([pa.array(kind), pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], schema=out)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, parts: int = PARTS, probes: int = PROBES, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"), F.col(f"`{label_col}`").cast("string").alias("label"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("x", lambda v: v != 0)
    usable = F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False))
    # a class is known by 128 bits of its label and components
    mark = F.when(usable, F.struct(F.xxhash64("label", "x").alias("h"), F.xxhash64("x", "label", F.lit(1)).alias("g")))
    rows = written(rows.withColumn("mark", mark), "vectors")
    width = int(rows.agg(F.coalesce(F.max(F.size("x")), F.lit(1))).first()[0])
    classes = rows.where("mark is not null").groupBy("mark").agg(F.min("vec_id").alias("u"), F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("label").alias("label"))
    classes = written(classes, "classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units(batch.column(3).to_pylist(), width)
            salt = batch.column(2).to_numpy()[:, None]
            with np.errstate(over="ignore"):
                keys = bucket_keys(x, tables, parts, probes).reshape(len(x), -1) * np.int64(0x9E3779B97F4A7C1 | 1) ^ salt
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(x), pa.list_(pa.float64()))], ["u", "n", "keys", "unit"])

    hashes = written(classes.select("u", "n", F.xxhash64("label").alias("salt"), "x").mapInArrow(hashed, "u long, n long, keys array<long>, unit array<double>"), "hashes")
    buckets = hashes.select("u", F.explode(F.array_distinct("keys")).alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = buckets.join(full, "bucket").withColumn("chunks", F.ceil(F.col("size") / chunk)).withColumn("c", F.pmod(F.xxhash64("u"), F.col("chunks")))
    pairs = met.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("bucket", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "u")
    found = written(pairs.join(hashes, "u").groupBy("bucket", "i", "j").applyInArrow(_compared(cosine), "kind int, u long, v long"), "links")
    counts = found.where("kind = 0").groupBy("u").agg(F.sum("v").alias("others"))
    reach = connected_components(found.where("kind = 1").select("u", "v"))
    named = classes.select("mark", "u", "n").join(counts, "u", "left").join(reach, F.col("u") == F.col("node"), "left")
    named = written(named.select(F.col("mark").alias("of"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "u").alias("component_id")), "classes_named")
    done = rows.join(named, F.col("mark") == F.col("of"), "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
