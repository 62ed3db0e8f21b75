"""Packing of documents into token sequences: first-fit decreasing over a tournament tree of bin capacities.

Each document's ids and the end id are cut into full sequences and a rest. The rests, dealt into random groups by a hash of
the row, are packed group by group: the longest first, each into the first bin that has room. The tree holds the largest
free capacity below each node, so that bin is found in log(bins) steps. Then the emptiest bins are dissolved: their pieces
are cut to fill the gaps of the fuller ones, so that a group has one open sequence at most.

Only rests move (fewer than ``size`` ids each, two bytes an id where they allow it), with the checksums of full pieces.

Nulls: a null text is an empty document: the end id only. Repeated rows are documents of their own. Empty tables give no
rows. Other columns are not read. A document of any length is cut, never dropped. Equal lengths keep their order of
(doc_id, checksum), so the result does not depend on the partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe, default_path
from .common import renamed, small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Documents in a group, on average. A group's rests are 4 MB at most; its one open sequence is a thousandth of it.
GROUP = 2048


class Tournament:
    """Free capacity of ``n`` bins of ``size``; each inner node holds the larger of its two children."""

    def __init__(self, n: int, size: int) -> None:
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.tree = [size] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """Take ``need`` from the first bin that has it; there are as many bins as items, so one has."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < need:
                k += 1
        found = k - self.leaves
        tree[k] -= need
        while k > 1:
            k //= 2
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
        return found


def first_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Items of each bin. Items are placed from the longest to the shortest, equal ones in the given order."""
    tree, bins = Tournament(len(lengths), size), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = tree.place(lengths[item])
        if k == len(bins):
            bins.append([])
        bins[k].append(item)
    return bins


def filled_up(bins: list[list[int]], lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """(item, from, length) of each bin, after the emptiest bins have been cut up to fill the gaps of the others."""
    out = sorted(([(i, 0, lengths[i]) for i in b] for b in bins), key=lambda b: -sum(p[2] for p in b))
    k = 0
    while k < len(out) - 1:
        gap = size - sum(p[2] for p in out[k])
        while gap and k < len(out) - 1:
            item, at, length = out[-1].pop()
            take = min(gap, length)
            out[k].append((item, at, take))
            if take < length:
                out[-1].append((item, at + take, length - take))
            if not out[-1]:
                out.pop()
            gap -= take
        k += 1
    return out


def pack(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end_id: int = 0, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; no sequence exceeds ``size``."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    end = np.uint32(end_id).tobytes()
    schema = pa.schema([("g", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("full", pa.binary()), ("rest", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                g, ids, texts = batch.slice(lo, 2000).columns
                n, full, rest = [], [], []
                for got in bpe.encode(texts):
                    got += end
                    n.append(len(got) // 4)
                    whole = n[-1] // size * size
                    full.append(np.array([zlib.crc32(got[4 * i : 4 * (i + size)]) for i in range(0, whole, size)], "<u4").tobytes())
                    rest.append(got[4 * whole :])
                yield pa.RecordBatch.from_arrays([g, ids, pa.array(n, pa.int64()), pa.array(full, pa.binary()), pa.array([_narrow(r) for r in rest], pa.binary())], schema=schema)

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(c=[zlib.crc32(r) for r in rows["rest"]]).sort_values(["doc_id", "n", "c"], kind="stable")
        docs_, ns, fulls = rows["doc_id"].array, rows["n"].to_numpy(), list(rows["full"])
        rests = [_wide(r) for r in rows["rest"]]
        out: list[tuple] = []
        sequence = int(key[0]) << 32
        for d, n, full in zip(docs_, ns, fulls):
            for j, c in enumerate(np.frombuffer(full, "<u4").tolist()):
                out.append((d, j * size, size, c, n, sequence, 0))
                sequence += 1
        some = [i for i, r in enumerate(rests) if len(r)]
        lengths = [len(rests[i]) // 4 for i in some]
        for pieces in filled_up(first_fit_decreasing(lengths, size), lengths, size):
            offset = 0
            for item, at, length in pieces:
                i = some[item]
                out.append((docs_[i], ns[i] - lengths[item] + at, length, zlib.crc32(rests[i][4 * at : 4 * (at + length)]), ns[i], sequence, offset))
                offset += length
            sequence += 1
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    rows = renamed(docs, {"doc_id": id_col, "text": text_col}).withColumn("doc_id", F.col("doc_id").cast("long"))
    groups = max(1, -(-rows.count() // group))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g"), "doc_id", "text")
    return rows.mapInArrow(cut, "g long, doc_id long, n long, full binary, rest binary").groupBy("g").applyInPandas(packed, PIECES)


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where they all allow it; the first byte says so."""
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\4" + ids


def _wide(data: bytes) -> bytes:
    return np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes() if data[:1] == b"\2" else data[1:]
