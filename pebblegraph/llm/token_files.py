"""Token ids of a corpus as files, in ascending order of the documents' ids, and their way back.

``write_tokens`` encodes whole texts where they are read, appends the end id, and sends the ids alone, two bytes each where
the vocabulary allows it, to ranges of doc_id. Each range is sorted, and runs of documents are packed into Simple-8b segments
(see simple8b.py). The ranges' bounds come from a sample of the id column, as in a range partitioning; an id that fills
several ranges is dealt out over all of them. A file row is one segment with the documents' ids, its range and the ids that
its range has before it. ``read_tokens`` decodes segments by themselves; a document's place in the corpus is the sum of the
ranges before (one row a range), of its range's segments before, and of the documents before it in the segment.

Nulls: a null text is an empty document (the end id only); null ids come first, in ranges of their own. Repeated rows and
equal ids stay, in a row, in an order that the table's partitions give. Empty tables give no rows. Other columns are not
read. A text of any length is encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .byte_bpe import byte_bpe, default_path
from .common import renamed, small_batches

SEGMENT = "part int, seq int, before long, n_ids long, doc_ids array<long>, payload binary"
#: Documents in a range, on average, where the session asks for no more ranges; ranges at most; sampled ids for each range.
RANGE_DOCS, RANGES, SAMPLED = 50_000, 20_000, 50
#: Ranges whose starts are broadcast at most; more are joined.
BROADCAST_RANGES = 1_000_000


def _kind(largest: int, end_id: int) -> np.dtype:
    return np.dtype("<u2" if max(largest, end_id) < 1 << 16 else "<u4")


def _ranges(ids: DataFrame, most: int = RANGES) -> tuple[int, np.ndarray]:
    """Ranges of null ids, and the first id of each other range but the first, from a sample of the ids that grows with the ranges only."""
    spark = ids.sparkSession
    n, some = ids.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    ranges = min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_DOCS))
    nulls = -(-(n - some) * ranges // n) if n else 0
    drawn = ids.where("doc_id is not null").sample(min(1.0, SAMPLED * ranges / max(1, some)), seed=1).toPandas()["doc_id"]
    drawn = np.sort(drawn.to_numpy(np.int64))
    cuts = np.arange(1, max(1, ranges - nulls)) * len(drawn) // max(1, ranges - nulls)
    return nulls, drawn[cuts] if len(drawn) else drawn


def encoded(docs: DataFrame, nulls: int, bounds: np.ndarray, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part (the range), doc_id, place (in the table), ids (little-endian, the end id last) of each row.

    An id has two bytes if all ids of the vocabulary fit, else four. nulls: ranges for null ids, which come first.
    """
    tokenizer = tokenizer or default_path()

    def part_of(doc_ids: pa.Array, place: np.ndarray) -> np.ndarray:
        known = np.asarray(doc_ids.fill_null(0))
        first, last = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
        return np.where(np.asarray(doc_ids.is_null()), place % max(1, nulls), nulls + first + place % (last - first + 1)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        kind = _kind(bpe.largest, end_id)
        for batch in batches:
            at = 0
            for ids, ends in bpe.flat(batch.column(1)):
                stop = ends + np.arange(1, len(ends) + 1)
                out = np.full(len(ids) + len(ends), end_id, kind)
                inner = np.ones(len(out), bool)
                inner[stop - 1] = False
                out[inner] = ids
                edge = pa.array(np.concatenate([[0], stop]) * kind.itemsize, pa.int32())
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, edge.buffers()[1], pa.py_buffer(out)])
                names, place = (batch.column(k).slice(at, len(ends)) for k in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(part_of(names, place.to_numpy())), names, place, binary], ["part", "doc_id", "place", "ids"])
                at += len(ends)

    rows = renamed(docs, {"doc_id": id_col, "text": text_col}).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    return rows.mapInArrow(run, "part int, doc_id long, place long, ids binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, segment_ids: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents under ``path``; a segment closes at ``segment_ids`` ids."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_path()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(byte_bpe(tokenizer).largest, end_id)
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[pa.Array] = []
        part = seq = before = n = 0

        def out() -> pa.RecordBatch:
            payload = simple8b.pack(np.concatenate(sizes), np.concatenate(held))
            row = [[part], [seq], [before], [n], [pa.concat_arrays(names).to_pylist()], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], ["part", "seq", "before", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, of = batch.column(2), batch.column(0).to_numpy()
            offset = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            flat = np.frombuffer(ids.buffers()[2], np.uint8)[offset[0] : offset[-1]].view(kind)
            ends = (offset[1:] - offset[0]).astype(np.int64) // kind.itemsize
            at = 0
            while at < len(of):
                if of[at] != part:
                    if sizes:
                        yield out()
                    part, seq, before, n = int(of[at]), 0, 0, 0
                    held, sizes, names = [], [], []
                base = int(ends[at - 1]) if at else 0
                to = min(int(np.searchsorted(of, part, "right")), int(np.searchsorted(ends, base + segment_ids - n)) + 1)
                held.append(flat[base : ends[to - 1]])
                sizes.append(np.diff(ends[at:to], prepend=base))
                names.append(batch.column(1).slice(at, to - at))
                n += int(ends[to - 1]) - base
                at = to
                if n >= segment_ids:
                    yield out()
                    seq, before, n = seq + 1, before + n, 0
                    held, sizes, names = [], [], []
        if sizes:
            yield out()

    nulls, bounds = _ranges(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")))
    rows = encoded(docs, nulls, bounds, tokenizer, end_id, id_col, text_col)
    dealt = rows.repartitionById(nulls + len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "place").select("part", "doc_id", "ids")
    dealt.mapInArrow(segments, SEGMENT).write.parquet(path)


def decoded(segments: DataFrame) -> DataFrame:
    """doc_id, its place in the range, ids as little-endian unsigned 32-bit bytes; one row for each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, ids = simple8b.unpack(row["payload"])
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), row["part"]), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["before"]), pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends)], pa.binary())], ["part", "doc_id", "at", "ids"])

    return segments.select("part", "before", "doc_ids", "payload").mapInArrow(rows, "part int, doc_id long, at long, ids binary")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files alone."""
    segments = spark.read.schema(SEGMENT).parquet(path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, before, doc_ids, payload = (column[k] for column in batch.columns)
                lengths, ids = simple8b.unpack(memoryview(payload.as_buffer()))
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), part.as_py()), pa.int32()), doc_ids.values, pa.array(ends - lengths + before.as_py()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = segments.select("part", "before", "doc_ids", "payload").mapInArrow(digests, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row a range, and a writer's task makes one: few, whatever the corpus
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if segments.select("part").distinct().count() <= BROADCAST_RANGES:
        base = F.broadcast(base)
    return found.join(base, "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
