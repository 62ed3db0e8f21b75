"""Removal of word passages that occur more than once in a corpus, whatever its size.

A window is ``window`` words in a row. Every window whose words occur as a window anywhere else goes, judged on the input.

The corpus is dealt into blocks of a few MB by a hash of the row, and questions of the form "which of my keys does any other
place hold?" are asked of all blocks at once: a block sends its distinct keys, sorted and cut by their top bits, with a flag
for those that it has twice itself; one task per range of keys merges them and answers with a flag for each key. Two rounds:

1. Each window has a minimiser, the ``gram``-word shingle with the least hash in it; equal windows have equal minimisers.
   Blocks ask about their minimisers, a twelfth of their words, by 64 bits.
2. Blocks ask about their windows whose minimiser occurs twice, by 128 bits: two rolling sums over the two halves of each
   word's XXH3.

Windows count as equal if these 128 bits are; words are not compared, so the result is exact but for a collision of 128 bits
(for n windows, n^2 in 2^129 cases). What moves is the text once (all rounds read the same exchange), 9 bytes for each
minimiser, 17 for each suspected window, and a byte back for each of them. They move in one row for each range that a block
has keys in, never more rows than keys: in a corpus of over 10^5 ranges nearly each minimiser is a row of its own, and some
50 bytes of row come on top. A block looks at its own keys only, so its work does not grow with the number of ranges. A
passage that a third of all documents share is one key of each block, so no task sees more of it than there are blocks. Rows
that are equal in all columns share a block.

Suffix automata of reference shards (``SuffixAutomaton``, ``reference_spans``) are the method for a reference of bounded
size, such as a benchmark. For a corpus against itself every document would meet the automaton of every shard, which grows
with the square of the corpus; hence the exchange above. See the README for figures.

Nulls: a null text has no words and stays null. A text of fewer words than a window, or without repeated windows, is kept
as it is. Repeated rows are documents of their own, so they repeat each other. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes, with_row

WINDOW = 35
GRAM = 12
#: Bytes of text in a block and for each key range, on average.
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 16 << 20
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


class _Hashes(dict):
    """XXH3 of words, 16 bytes each."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        found = self[word] = xxhash.xxh3_128_digest(word)
        return found


def _powers(n: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and their inverses."""
    for down in (False, True):
        if len(_POWERS.get((half, down), ())) < n:
            steps = np.full(max(1 << 16, 1 << (n - 1).bit_length()), np.uint64(pow(_STEPS[half], -1, 1 << 64) if down else _STEPS[half]))
            steps[0] = 1
            _POWERS[half, down] = np.multiply.accumulate(steps)
    return _POWERS[half, False][:n], _POWERS[half, True][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Keys:
    """Distinct keys in order (one column each 64 bits), which of them came twice, and each given key's place among them."""

    def __init__(self, *columns: np.ndarray) -> None:
        order = np.argsort(columns[0])
        columns_ = [c[order] for c in columns]
        same = columns_[0][1:] == columns_[0][:-1]
        if any((same & (c[1:] != c[:-1])).any() for c in columns_[1:]):  # equal in the first 64 bits only
            order = np.lexsort(columns[::-1])
            columns_ = [c[order] for c in columns]
            same = np.logical_and.reduce([c[1:] == c[:-1] for c in columns_])
        first = np.concatenate([np.ones(min(1, len(order)), bool), ~same])
        start = np.nonzero(first)[0]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(first) - 1
        self.columns = [c[start] for c in columns_]
        self.twice = np.diff(start, append=len(order)) > 1


class Block:
    """Hashes of the words, windows and minimisers of some texts."""

    def __init__(self, texts: Iterable[str | None], window: int, gram: int) -> None:
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        n, of = int(self.size.sum()), _Hashes()
        halves = np.frombuffer(b"".join([h for w in self.words for h in map(of.__getitem__, w)]), "<u8").reshape(n, 2)
        self.window = window
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(halves[:, half] * _powers(n + 1, half)[0][:n], dtype=np.uint64)]) for half in (0, 1)]
        left = np.repeat(np.cumsum(self.size), self.size) - np.arange(n)  # words from here to the document's end
        self.at = np.nonzero(left >= window)[0]  # where windows start
        self.least = np.zeros(0, np.int64)
        grams = np.zeros(0, np.uint64)
        if len(self.at):
            grams = self._hash(np.arange(n - gram + 1), gram, 0)
            # the least hash, and of equal ones the first: 32 bits of hash above 32 bits of place
            low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            span, width = window - gram + 1, 1
            while width * 2 <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < span:
                low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
            self.least = (low[self.at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # a minimiser's place, and for each window which of them is its own
        places = np.unique(self.least)
        self.minimisers = Keys(grams[places])
        self.own = self.minimisers.place[np.searchsorted(places, self.least)]

    def _hash(self, at: np.ndarray, length: int, half: int) -> np.ndarray:
        sums, down = self.sums[half], _powers(len(self.sums[half]), half)[1]
        return _mixed((sums[at + length] - sums[at]) * down[at])

    def suspects(self, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows whose minimiser is shared. shared: a flag for each of the minimisers."""
        return self.at[shared[self.own]]

    def windows(self, at: np.ndarray) -> Keys:
        return Keys(*(self._hash(at, self.window, half) for half in (0, 1)))

    def covered(self, at: np.ndarray, keys: Keys, shared: np.ndarray) -> np.ndarray:
        """A flag for each word of the block. at: the suspects; keys: windows(at); shared: a flag for each of them."""
        n = int(self.size.sum())
        edge = np.zeros(n + 1, np.int64)
        gone = at[shared[keys.place]]
        edge[gone] += 1
        edge[gone + self.window] -= 1
        return np.cumsum(edge)[:n] > 0


_ASK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())])
_TELL = pa.schema([("block", pa.int64()), ("round", pa.int32()), ("part", pa.int32()), ("shared", pa.binary())])


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of values; ends: where each one ends."""
    values = np.ascontiguousarray(values)
    edge = np.concatenate([[0], ends]) * (values.nbytes // max(1, len(values)))
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.array(edge, pa.int32()).buffers()[1], pa.py_buffer(values)])


def _raw(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes, one after the other, and each row's number of bytes."""
    parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for c in column.chunks:
        if len(c):
            edge = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[edge[0] : edge[-1]])
            sizes.append(np.diff(edge).astype(np.int64))
    return np.concatenate(parts), np.concatenate(sizes)


def _asked(block: int, keys: Keys, bits: int) -> pa.Table:
    """One row for each range (the top ``bits`` of a key) that has keys of the block."""
    first = keys.columns[0]
    part = (first >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(first), np.int32)
    ends = np.concatenate([np.nonzero(part[1:] != part[:-1])[0] + 1, [len(part)]]) if len(part) else np.zeros(0, np.int64)
    flat = np.column_stack(keys.columns)
    return pa.table([pa.array(part[ends - 1], pa.int32()), pa.array(np.full(len(ends), block), pa.int64()), _binary(flat, ends), _binary(keys.twice, ends)], schema=_ASK)


def _answered(number: int):
    def merge(table: pa.Table) -> pa.Table:
        (keys, _), (twice, size) = _raw(table["keys"]), _raw(table["twice"])
        keys = keys.view(np.uint64).reshape(len(twice), -1)
        found = Keys(*(np.ascontiguousarray(keys[:, k]) for k in range(keys.shape[1])))
        shared = found.twice[found.place] | twice.view(bool)
        return pa.table([table["block"], pa.array(np.full(len(size), number), pa.int32()), table["part"], _binary(shared, np.cumsum(size))], schema=_TELL)

    return merge


def _flags(answers: pa.Table, number: int, keys: Keys) -> np.ndarray:
    """A flag for each key: the answers in the order of their ranges."""
    own = answers.filter(pa.compute.equal(answers["round"], number)).sort_by("part")
    out = _raw(own["shared"])[0].view(bool)
    if len(out) != len(keys.twice):
        raise RuntimeError(f"{len(out)} answers to {len(keys.twice)} questions")
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns but the text), ``text`` (what is left), n_words, n_removed of each document.

    What is left of a text that loses words is its other words, joined by one space.
    """
    if not 0 < gram <= window:
        raise ValueError("a shingle of 1 to window words is needed")
    spark = docs.sparkSession
    small_batches(spark)
    _, size = text_bytes(docs, text_col)
    blocks, bits = max(1, size // block_bytes), min(30, max(0, size // range_bytes - 1).bit_length())
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*rest).alias("row") if rest else F.struct(F.lit(0).alias("_")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row", "text"), F.lit(blocks)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 4)
    by_block = rows.repartition(parts, "block").groupBy("block")
    ask, tell = "part int, block long, keys binary, twice binary", "block long, round int, part int, shared binary"

    def first(table: pa.Table) -> pa.Table:
        return _asked(table["block"][0].as_py(), Block(table["text"].to_pylist(), window, gram).minimisers, bits)

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ASK.empty_table()
        block = Block(table["text"].to_pylist(), window, gram)
        at = block.suspects(_flags(answers, 1, block.minimisers))
        return _asked(table["block"][0].as_py(), block.windows(at), bits)

    def third(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table["text"].to_pylist()
        block = Block(texts, window, gram)
        at = block.suspects(_flags(answers, 1, block.minimisers))
        keys = block.windows(at)
        gone = block.covered(at, keys, _flags(answers, 2, keys))
        ends = np.cumsum(block.size)
        removed, start = [], 0
        for k, (words, end) in enumerate(zip(block.words, ends.tolist())):
            flags = gone[start:end]
            removed.append(int(flags.sum()))
            if removed[-1]:
                texts[k] = b" ".join([words[i] for i in np.nonzero(~flags)[0]]).decode("utf-8", "surrogatepass")
            start = end
        return pa.table([table["row"].combine_chunks(), pa.array(texts, pa.string()), pa.array(block.size), pa.array(removed, pa.int64())], ["row", "text", "n_words", "n_removed"])

    told = by_block.applyInArrow(first, ask).groupBy("part").applyInArrow(_answered(1), tell)
    asked = by_block.cogroup(told.groupBy("block")).applyInArrow(second, ask)
    told = told.union(asked.groupBy("part").applyInArrow(_answered(2), tell))
    out = with_row(rows, "text string, n_words long, n_removed long")
    return by_block.cogroup(told.groupBy("block")).applyInArrow(third, out)


class SuffixAutomaton:
    """The words' suffix automaton of a reference: each state a class of passages, ``feed`` the longest one that ends here."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, words: Iterable[bytes]) -> None:
        """Another reference text; passages do not run over from the one before."""
        self.last = 0
        for w in words:
            self._extend(w)

    def _clone(self, p: int, q: int, w: bytes) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, w: bytes) -> None:
        p = self.last
        if w in self.next[p]:
            q = self.next[p][w]
            self.last = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
            return
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[p] + 1)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        self.last = cur

    def matches(self, words: Iterable[bytes]) -> Iterator[int]:
        """At each word, the length of the longest passage of the reference that ends there."""
        at = size = 0
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if w in self.next[at]:
                at, size = self.next[at][w], size + 1
            yield size


def reference_spans(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = 200_000, most_words: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text") -> DataFrame:
    """doc_id, spans (array of first word and end): maximal passages of ``window`` words or more that the reference has.

    The reference is cut into shards of whole texts, each one broadcast; a task builds its automaton once and streams its
    documents through it. A reference of over ``most_words`` words is refused: match it with without_repeats() instead.
    """
    words = F.size(F.regexp_extract_all(F.col(f"`{reference_col}`"), F.lit(r"([^\x20\x09-\x0D]+)")))
    total = reference.agg(F.coalesce(F.sum(F.greatest(words, F.lit(0))), F.lit(0))).first()[0]
    if total > most_words:
        raise ValueError(f"{total} words of reference; {most_words} at most can be broadcast")
    shards: list[list[list[bytes]]] = [[]]
    held = 0
    for (text,) in reference.select(F.col(f"`{reference_col}`")).toLocalIterator():
        own = (text or "").encode("utf-8", "surrogatepass").split()
        if held + len(own) > shard_words and shards[-1]:
            shards.append([])
            held = 0
        shards[-1].append(own)
        held += len(own)
    sent = [docs.sparkSession.sparkContext.broadcast(s) for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for s in sent:
            automata.append(SuffixAutomaton())
            for text in s.value:
                automata[-1].add(text)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                own = (text or "").encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(own) + 1, np.int64)
                for a in automata:
                    size = np.fromiter(a.matches(own), np.int64, len(own))
                    for end in np.nonzero(size >= window)[0]:
                        edge[end + 1 - size[end]] += 1
                        edge[end + 1] -= 1
                inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                turn = np.nonzero(inside[1:] != inside[:-1])[0]
                out.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long>>")
