"""Byte-level BPE ids of whole texts by the tokenizers library, with a bounded cache of frequent words.

The pre-tokeniser never joins a character that is not white space with white space that follows it, so a text may be cut
there. Texts are cut before each space, unless a space follows other white space; such a text is encoded as it is. Arrow
cuts the texts of a slice, numbers their distinct words and finds those that are cached; the others are encoded many at a
time, in one string, and told apart by the bytes that each id stands for; numpy puts the words' ids together. So the ids are
those of the library in every case.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .word_cache import WordCache, gathered, joined, slices

#: Words that are encoded as one string.
RUN = 128


class ByteBpe:
    """``flat(texts)`` yields the ids of some texts at a time and where each one ends, ``encode(texts)`` each text's ids.

    ``special_as_text``: strings of special tokens inside a text are ordinary text, as they are in documents.
    ``cached``: words that are kept at most, if a slice had them twice; all others are encoded anew each time.
    """

    def __init__(self, path: str, special_as_text: bool = True, cached: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special_as_text = special_as_text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.largest = max(vocabulary.values())
        self.bytes_of = np.zeros(self.largest + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # one character a byte
        self.kept = WordCache(cached)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and each one's number of ids."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of a space and each of these words; none is empty or ends in white space."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, _ = self._each([" " + run for run in joined(words, " ", RUN)])
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(np.asarray(pc.binary_length(words)) + 1)) + 1
        return ids, np.diff(ends, prepend=0)

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(texts, " ")
        offsets = np.asarray(parts.offsets)
        base = int(offsets[0])
        coded = parts.values.slice(base, int(offsets[-1]) - base).dictionary_encode()
        offsets = offsets - base
        at, names = np.array(coded.indices, np.int64), coded.dictionary
        place = self.kept.places(names)
        first, last = offsets[:-1], offsets[1:] - 1
        # a part that is empty or ends in white space, and is not a text's last, or its first if it is empty
        missing = np.nonzero(place < 0)[0]
        fresh = names.take(pa.array(missing))
        is_bad = np.asarray(pc.match_substring_regex(fresh, r"(^|[\s\v\x1c-\x1f\x{85}\p{Z}])$"))
        bad = np.zeros(len(names), bool)
        bad[missing[is_bad]] = True
        odd = bad[at]
        odd[last] = False
        empty = pc.index(names, "").as_py()
        odd[first[at[first] == empty]] = False
        whole = np.nonzero(np.add.reduceat(odd, first))[0] if len(at) else np.zeros(0, int)
        if not self.special_as_text:
            whole = np.union1d(whole, np.nonzero(np.asarray(pc.match_substring(texts, "<|")))[0])
        # heads have no space before them; a text that is not cut is all head; a last part that is bad is encoded alone
        heads = names.take(pa.array(at[first])).to_pylist()
        for k in whole.tolist():
            heads[k] = texts[k].as_py()
        tails = np.setdiff1d(at[last[last > first]], missing[~is_bad])
        tails = tails[bad[tails]]
        good = missing[~is_bad]
        plain = self._new(fresh.filter(pa.array(~is_bad)))
        found = [(self.kept.ids, self.kept.size), plain, self._each([f" {w}" for w in names.take(pa.array(tails)).to_pylist()]), (np.zeros(0, np.uint32), np.zeros(1, np.int64)), self._each(heads)]
        known = len(self.kept)
        place[good] = known + np.arange(len(good))
        place[tails] = known + len(good) + np.arange(len(tails))
        none = known + len(good) + len(tails)
        row = place[at]
        for k in whole.tolist():
            row[first[k] : last[k] + 1] = none
        row[first] = none + 1 + np.arange(len(first))
        out, end = gathered(*(np.concatenate(x) for x in zip(*found)), row)
        self.kept.keep(names.take(pa.array(good)), *plain, np.bincount(at, minlength=len(names))[good])
        return out, end[last]

    def flat(self, texts: pa.Array | Iterable[str | None], at_once: int = 8_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts in order (unsigned, 32 bits), and where each text ends in them. Null counts as empty.

        Texts of about ``at_once`` bytes are held at a time.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        column = pc.fill_null(column, "")
        for i, j in slices(column, at_once):
            yield self._some(column.slice(i, j - i))

    def encode(self, texts: pa.Array | Iterable[str | None], at_once: int = 8_000_000) -> Iterator[bytes]:
        """The ids of each text in order, as little-endian unsigned 32-bit bytes."""
        for ids, ends in self.flat(texts, at_once):
            out, start = ids.astype("<u4", copy=False).tobytes(), 0
            for end in ends.tolist():
                yield out[4 * start : 4 * end]
                start = end


_MADE: dict[tuple, ByteBpe] = {}


def byte_bpe(path: str, special_as_text: bool = True) -> ByteBpe:
    """One tokenizer per worker process; its library starts no threads."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, special_as_text) not in _MADE:
        _MADE[path, special_as_text] = ByteBpe(path, special_as_text)
    return _MADE[path, special_as_text]


def default_path() -> str:
    """The public byte-level vocabulary of 50,257 ids, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
