"""SimHash near-duplicates: fingerprints, exact links at a small Hamming distance, and their components.

Fingerprints are embedded segment by segment: a segment is two bits, its coordinate is its popcount, so a fingerprint is a
point of {0, 1, 2}^32, held two bits a coordinate as 00, 01 and 11, so that the Manhattan distance of two points is the number
of bits in which they differ. A flipped bit of a fingerprint moves one coordinate by one, so that distance is at most the
Hamming distance. The range join at Manhattan distance 3 or less runs over a grid: the 32
coordinates are dealt into six blocks; three moves leave at least three blocks as they are; each choice of three blocks is
one grid, whose cell is the point's coordinates there. Points within reach share a cell of one of the 20 grids. Inside a
cell, the points' Manhattan distances are taken first, and the fingerprints of those within reach are compared.

Equal fingerprints are one point, so a group of copies of any size is one row here. Cells with one point end before the
comparison. Cells with many points are cut into chunks of bounded size, and each pair of chunks is compared on its own;
only a spanning forest of the links found leaves a task, never all pairs.

Nulls: a null text has no words, so fingerprint zero, which links like any other. A null id keeps its row; a component of
null ids only has a null component_id. Repeated rows stay. Empty tables give no rows. Other columns are not read here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .components import connected_components

SEED = 42
DISTANCE = 3
BLOCKS = DISTANCE + 3
#: Points of a cell that meet in one task are twice as many at most.
CHUNK = 8192


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[int]:
    """For each grid, the bits of the coordinates of its three blocks."""
    cuts = [round(i * 32 / BLOCKS) for i in range(BLOCKS + 1)]
    block = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(block, BLOCKS - DISTANCE)]


def embedded(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, each in its own two bits: 00, 01 or 11."""
    low, high = fp.bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def points_of(fp: np.ndarray) -> np.ndarray:
    """The same of an array of fingerprints."""
    even = np.uint64(0x5555555555555555)
    low, high = fp & even, fp >> np.uint64(1) & even
    return low | high | (low & high) << np.uint64(1)


def _near(fp: np.ndarray, point: np.ndarray, a: np.ndarray, b: np.ndarray | int, distance: int) -> np.ndarray:
    """Those of the rows a that are linked to the rows b: Manhattan distance of the points first, then the fingerprints."""
    b = np.broadcast_to(b, a.shape)
    some = np.nonzero(np.bitwise_count(point[a] ^ point[b]) <= distance)[0]
    return a[some[np.bitwise_count(fp[a[some]] ^ fp[b[some]]) <= distance]]


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the XXH64 of the text's shingles (A-Z in lower case, repeats count)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), dtype=">u8", count=n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1 and k2 (hashes that know a row), fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(3).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], ["doc_id", "k1", "k2", "fp"])

    small_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col).select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "k1", "k2", F.col(f"row.`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (a struct of all columns), and two hashes of id, text and all other columns but maps, which have no order."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString()]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(i, t, *others).alias("k1"), F.xxhash64(t, i, F.lit(1), *others).alias("k2"))


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that hold together what is linked between points of ``a`` and ``b`` (the same array: within it)."""
    same = a is b
    points = a if same else np.concatenate([a, b])
    side = np.zeros(len(points), bool)
    side[len(a) :] = not same
    left, out, embedding = np.ones(len(points), bool), [], points_of(points)
    for start in range(len(points)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            rest = np.nonzero(left if same else left & (side != side[at]))[0]
            near = _near(points, embedding, rest, at, distance)
            if len(near):
                left[near] = False
                out.append((np.full(len(near), points[at]), points[near]))
                todo.extend(near.tolist())
    return out


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (grid, cell, i, j, c, fp) sorted by the first four: a spanning forest of the links within each group."""

    def found(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        head = rows[:, :4]
        start = np.concatenate([[0], np.nonzero((head[1:] != head[:-1]).any(axis=1))[0] + 1, [len(rows)]])
        size = np.diff(start)
        fp = np.ascontiguousarray(rows[:, 5]).view(np.uint64)
        point = points_of(fp)
        # small groups all at once: each row against the k-th row after it
        group = np.repeat(np.arange(len(size)), size)
        small = size <= 24
        live = np.nonzero(small[group])[0]
        k = 1
        while len(live):
            live = live[live + k < len(rows)]
            live = live[group[live + k] == group[live]]
            near = _near(fp, point, live, live + k, distance)
            yield fp[near], fp[near + k]
            k += 1
        for g in np.nonzero(~small)[0]:
            some = slice(start[g], start[g + 1])
            i, j = rows[start[g], 2:4]
            points, chunk = fp[some], rows[some, 4]
            a = points[chunk == i]
            yield from _forest(a, a if i == j else points[chunk == j], distance)

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = list(found(rows))
        u, v = (np.concatenate([p[k] for p in pairs] + [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
        for i in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], ["u", "v"])

    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if not len(rows):
            continue
        held.append(rows)
        if (rows[-1, :4] == held[0][0, :4]).all():
            continue  # one group so far; it is bounded by two chunks
        all_rows = np.concatenate(held)
        last = int(np.nonzero((all_rows[:, :4] != all_rows[-1, :4]).any(axis=1))[0][-1]) + 1
        yield from out(all_rows[:last])
        held = [all_rows[last:]]
    if held:
        yield from out(np.concatenate(held))


def links(points: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """u, v: links at Hamming distance 3 or less between distinct fingerprints (column fp) that connect all that is linked."""
    if distance != DISTANCE:
        raise ValueError("the grids are laid out for distance 3")
    masks = F.array(*(F.struct(F.lit(k).alias("grid"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(_masks())))
    cells = points.select("fp", F.inline(masks)).select("fp", "grid", embedded(F.col("fp")).bitwiseAND(F.col("mask")).alias("cell"))
    full = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = cells.join(full, ["grid", "cell"]).withColumn("chunks", F.ceil(F.col("n") / chunk)).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    pairs = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("grid", "cell", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "fp")
    dealt = pairs.repartition("grid", "cell", "i", "j").sortWithinPartitions("grid", "cell", "i", "j")
    return dealt.mapInArrow(lambda b: _links(b, distance), "u long, v long").distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2, fp, component (a fingerprint), component_id (smallest id within reach of links) of each row."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    reach = connected_components(links(points))
    named = points.join(reach, points["fp"] == reach["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = written(named.join(least, "component").select(F.col("fp").alias("of"), "component", "component_id"), "labels")
    return rows.join(labels, rows["fp"] == labels["of"]).drop("of")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id within reach of links) of each row."""
    return grouped(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with one row of each component: that of the smallest id (of equal ids, the smallest hash)."""
    first = grouped(docs, id_col, text_col).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first"))
    kept = first.select("first.k1", "first.k2")
    return _keyed(docs, id_col, text_col).join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
