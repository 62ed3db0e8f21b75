"""A bounded cache of words' token ids in flat arrays, and the ids of texts put together from their words'."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class WordCache:
    """Words (an Arrow array), their ids one after the other, and each one's number of ids.

    most: words that are kept at most; a word is kept if a slice of texts had it twice and it has 40 bytes or fewer.
    """

    def __init__(self, most: int) -> None:
        self.most = most
        self.words, self.ids, self.size = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def places(self, names: pa.Array) -> np.ndarray:
        """Each name's place in the cache, or -1."""
        return np.asarray(pc.fill_null(pc.index_in(names, value_set=self.words), -1)).astype(np.int64)

    def keep(self, names: pa.Array, ids: np.ndarray, size: np.ndarray, count: np.ndarray) -> None:
        """Take in new names, given their ids and how often the slice had each."""
        room = self.most - len(self.words)
        if room <= 0 or not len(names):
            return
        kept = np.zeros(len(names), bool)
        kept[np.nonzero((count > 1) & (np.asarray(pc.binary_length(names)) <= 40))[0][:room]] = True
        self.words = pa.concat_arrays([self.words, names.filter(pa.array(kept))])
        self.ids = np.concatenate([self.ids, ids[np.repeat(kept, size)]])
        self.size = np.concatenate([self.size, size[kept]])


def gathered(ids: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some rows of a table (its ids one after the other, and each row's number of them), and where each one ends."""
    start = np.cumsum(size) - size
    n = size[rows]
    end = np.cumsum(n)
    return ids[np.repeat(start[rows] - (end - n), n) + np.arange(end[-1] if len(end) else 0)], end


def joined(words: pa.Array, between: str, run: int) -> list[str]:
    """Runs of words, each as one string."""
    edge = np.append(np.arange(0, len(words), run), len(words)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edge), words), between).to_pylist()


def slices(column: pa.Array, at_once: int) -> list[tuple[int, int]]:
    """Runs of rows that hold about ``at_once`` bytes, one row at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(column)))
    i, out = 0, []
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_once, side="right")))
        out.append((i, j))
        i = j
    return out
