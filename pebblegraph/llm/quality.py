"""Quality rules: fixed rules on document statistics, then gradient-boosted trees over them.

The trees are fitted on the driver to a bounded sample of labelled rows (``SAMPLE``: the labels whose hashed ids come first)
and flattened into arrays of nodes, so that a batch of documents goes down all trees in a few numpy steps a level. More
symbols, repeated words or repeated lines never raise a score: splits on those statistics must keep the order of their two
sides, and all values below a split stay on their side of its middle.

Nulls: a null text has no words and fails the base rules, as an empty one does. Labels that are null, or whose documents
are missing, are not used; without labels of both classes the trees keep everything. Repeated rows are judged each on its
own. Empty tables give no rows. Statistics cover whole texts of any length. Other columns ride along in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_row

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, and the direction in which each may move a score (0: any).
FEATURES = {"words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines_per_line": -1, "repeated_words": -1, "upper": 0, "digits": 0, "distinct_words": 0, "ended_lines": 0}
#: Labelled rows that the trees are fitted to, at most.
SAMPLE = 20_000
THRESHOLD = 0.5


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows that occur twice or more, and distinct words."""
    n, ids = len(words), {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if n < 4 or len(ids) == n:
        return 0, len(ids)
    size = len(ids)
    head = a[:-2] * size + a[1:-1]
    if size >= 1 << 21:
        head = np.unique(head, return_inverse=True)[1]
    _, which, count = np.unique(head * size + a[2:], return_inverse=True, return_counts=True)
    twice, covered = count[which] > 1, np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum()), len(ids)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base statistics and the features of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeat, distinct = _repeated(words)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=128) if raw else np.zeros(128, np.int64)
    ended = sum(x.rstrip(SPACE)[-1] in ".!?" for x in lines)
    per = lambda x, of: x / of if of else 0.0
    return [n, chars, symbols, dup, repeat], [float(n), per(chars, n), per(symbols, n), per(dup, len(lines)), per(repeat, n), per(int(codes[65:91].sum()), chars), per(int(codes[48:58].sum()), chars), per(distinct, n), per(ended, len(lines))]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@dataclass
class Trees:
    """Boosted trees as arrays of nodes. A leaf is its own child, so every row takes ``depth`` steps in every tree."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of logistic loss over binned features. monotone: -1, 0 or 1 for each feature."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, int)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(mean / (1 - mean)))
    feature, limit, left, right, value, roots = [], [], [], [], [], []
    score = np.full(len(x), start)

    def node(v: float) -> int:
        k = len(feature)
        feature.append(0)
        limit.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, level: int) -> int:
        G, H = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-G / (H + ridge), lo, hi))
        k = node(rate * own)
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth else ():
            if not len(edges[f]):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(edges[f]) + 1))[:-1]
            gr, hr = G - gl, H - hl
            vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2) + (G * own + 0.5 * (H + ridge) * own**2)
            gain[(hl < least * 0.01) | (hr < least * 0.01)] = 0
            if monotone[f]:
                gain[monotone[f] * (vr - vl) < 0] = 0
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (float(gain[j]), (f, j, float(vl[j]), float(vr[j])))
        if best[1]:
            f, j, vl, vr = best[1]
            go = binned[rows, f] <= j
            middle = (vl + vr) / 2
            a, b = ((lo, middle), (middle, hi)) if monotone[f] > 0 else ((middle, hi), (lo, middle)) if monotone[f] < 0 else ((lo, hi), (lo, hi))
            l, r = grow(rows[go], g, h, *a, level + 1), grow(rows[~go], g, h, *b, level + 1)
            feature[k], limit[k], left[k], right[k] = f, float(edges[f][j]), l, r
        return k

    for _ in range(trees if len(x) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        first = len(feature)
        roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), -8.0, 8.0, 0))
        one = Trees(np.array([0]), np.array(feature[first:]), np.array(limit[first:]), np.array(left[first:]) - first, np.array(right[first:]) - first, np.array(value[first:]), depth, 0.0)
        score = score + one.margin(x)
    return Trees(np.array(roots, int), np.array(feature, int), np.array(limit), np.array(left, int), np.array(right, int), np.array(value), depth, start)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees | None:
    """Trees fitted to at most ``sample`` labelled documents; None without labels of both classes."""
    small_batches(docs.sparkSession)
    some = labels.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{label_col}`").cast("double").alias("y")).dropna()
    some = some.orderBy(F.xxhash64("i"), "i", "y").limit(sample).dropDuplicates(["i"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([statistics(t)[1] for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))], ["i", "y", "x"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(some), "i").select("i", "y", "t")
    found = rows.mapInArrow(features, "i long, y double, x array<double>").groupBy("i").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("i")
    y = found["y"].to_numpy() > 0
    if not 0 < y.sum() < len(y):
        return None
    return fit(np.array(found["x"].to_list()), y.astype(float), list(FEATURES.values()))


def judged(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns but the text), ``text``, the base statistics, base_failed, score, kept."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(0).alias("_")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(1).to_pylist()]
            base = np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE))
            x = np.array([f for _, f in found]).reshape(-1, len(FEATURES))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            score = sent.value.probability(x) if sent.value else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], ["row", "text", *BASE, "base_failed", "score", "kept"])

    return rows.mapInArrow(run, with_row(rows, "text string, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"))
