"""Token ids in word-aligned blocks, after Anh and Moffat's Simple-8b.

A 64-bit word has a 4-bit selector on top and 60 bits of data. Selectors 1 to 14 pack ``COUNT`` values of ``BITS`` bits,
the first in the lowest bits. Selector 15 holds one value of 60 bits. Selector 0 is the escape: the next word is one raw
64-bit value. The last word of a block may be short of values; the header says how many there are.

A segment is ``S8B1``, then little-endian: documents (u32), ids (u64), blocks (u32), each document's ids (u32), each
block's first word (u32, one more at the end), and the words (u64). Each block has ``BLOCK`` ids, the last one fewer, and
decodes without any other, so all blocks are decoded at once in numpy.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
BLOCK = 512
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 30, 60])
#: From the most values to the fewest; 14 equals 15 in count and is never chosen.
ORDER = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 0]


#: Bits that each value below 2^16 needs, 1 at least.
_BITS16 = np.array([max(1, i.bit_length()) for i in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least."""
    if not len(ids) or ids.max() < 1 << 16:
        return _BITS16[ids]
    out = np.ones(len(ids), np.uint8)
    for b in range(1, 64):
        more = ids >> np.uint64(b) != 0
        if not more.any():
            break
        out[more] = b + 1
    return out


def _selectors(ids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The selector with the most values that may start at each position. left: ids from there to its block's end."""
    width, n = _widths(ids), len(ids)
    best = np.zeros(n, np.uint8)
    best[width <= 60] = 15
    # the widest of the 1, 2, 4, ... ids from each position; past the end it does not matter, as left is too small there
    at, widest = 1, width
    for s in reversed(ORDER[:-2]):  # ever more values of ever fewer bits: where none fits, none of the next ones does
        c = int(COUNT[s])
        while at * 2 <= c and at * 2 <= n:
            more = widest.copy()
            np.maximum(widest[:-at], widest[at:], out=more[:-at])
            at, widest = at * 2, more
        if c > n or int(widest.min()) > BITS[s]:
            break
        most = widest
        if c > at:
            most = widest.copy()
            np.maximum(widest[: at - c], widest[c - at :], out=most[: at - c])
        best[(most <= BITS[s]) & (left >= c)] = s
    return best


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words and each block's first word (one more at the end) of an array of unsigned integers."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    ends = np.minimum(np.arange(1, blocks + 1) * block, n)
    left = (np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)).astype(np.int32)
    sel = _selectors(ids, left)
    step = COUNT.astype(np.uint8)[sel]
    at, starts, which = np.arange(blocks) * block, [], []
    live = np.arange(blocks)
    while len(live):  # all blocks in step; each round places one word in each
        starts.append(at)
        which.append(live)
        at = at + step[at]
        go = at < ends[live]
        at, live = at[go], live[go]
    start, of = np.concatenate(starts), np.concatenate(which)
    order = np.argsort(start, kind="stable")
    start, of = start[order], of[order]
    chosen = sel[start].astype(np.int64)
    raw = chosen == 0
    place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(raw)[:-1]])
    words = np.zeros(len(start) + int(raw.sum()), np.uint64)
    for s in np.unique(chosen):
        rows = np.nonzero(chosen == s)[0]
        if s == 0:
            words[place[rows] + 1] = ids[start[rows]]
            continue
        value = np.full(len(rows), np.uint64(int(s) << 60))
        for j in range(int(COUNT[s])):
            value |= ids[start[rows] + j] << np.uint64(j * int(BITS[s]))
        words[place[rows]] = value
    first = np.concatenate([place[np.searchsorted(of, np.arange(blocks))], [len(words)]]).astype(np.uint32)
    return words, first


def decode(words: np.ndarray, first: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The inverse of encode(): all blocks at once, one pass for each selector that occurs."""
    words = np.asarray(words, dtype=np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    data = np.zeros(len(words), bool)
    if (chosen == 0).any():  # a raw word may look like anything, so the rare escapes are followed one by one
        for k in np.nonzero(chosen == 0)[0]:
            if not data[k]:
                data[k + 1] = True
    count = np.where(data, 0, COUNT[chosen])
    place = np.concatenate([[0], np.cumsum(count)[:-1]])
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(chosen[~data]):
        rows = np.nonzero((chosen == s) & ~data)[0]
        if s == 0:
            out[place[rows]] = words[rows + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNT[s])):
            out[place[rows] + j] = (words[rows] >> np.uint64(j * int(BITS[s]))) & mask
    return out[:n]


def pack(lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of documents."""
    words, first = encode(ids, block)
    head = MAGIC + struct.pack("<IQI", len(lengths), len(ids), len(first) - 1)
    return head + np.asarray(lengths, "<u4").tobytes() + first.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def unpack(data: bytes, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Each document's number of ids, and all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n, blocks = struct.unpack_from("<IQI", data, 4)
    at = 20
    lengths = np.frombuffer(data, "<u4", docs, at)
    first = np.frombuffer(data, "<u4", blocks + 1, at + 4 * docs)
    words = np.frombuffer(data, "<u8", -1, at + 4 * docs + 4 * (blocks + 1)) if blocks else np.zeros(0, np.uint64)
    return lengths, decode(words, first, n, block)
