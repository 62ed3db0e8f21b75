"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three transducers are compiled from a model file. The normaliser rewrites the longest match of its character map, and spaces
to U+2581 (``Normaliser``). The pieces are a trie whose arcs are arrays (state, character, next state); a state that spells a
piece has a final arc back to the start, which emits the piece at its weight (``Trie``). Byte fallback is one more arc for
each character that has no piece; it emits the ids of its UTF-8 bytes. Normalised text composed with them is a lattice:
``composed()`` follows the trie from every place at once, and each final arc becomes an arc of the lattice. The tropical
shortest path is the encoding.

- A unigram model weighs pieces by their negative log-probabilities, byte fallback by the least probable piece and ten more.
  The path is relaxed from left to right in single precision, and the first of equal paths stays, as in the original.
- A merge model (BPE) has an order of merges, not costs of paths. Its transducer remembers the last piece: an arc weighs
  nothing after a piece that it can stand next to, and infinity otherwise. Two pieces can stand next to each other if merging
  their joint text ends in just these two. A path whose neighbours all can is the result of the merges, and each prefix has
  one such path, so the shortest path is exact. All words of a slice are relaxed at once, place by place (``_paths``); a word
  of over ``LONG`` characters is relaxed by itself (``_path``).

In a merge model no piece holds U+2581 after another character, so a text may be cut before each space; frequent words are
kept (a bounded number). Models that cannot be compiled so are refused: merge models with user-defined or unused pieces or with
pieces that run over words, and models that keep spaces as they are or put them behind words.

Nulls: a null text is empty: no ids. Other columns are not read; repeated rows, empty tables and texts of any length need no
special case. Text with U+2581 itself decodes to a space there, as with the original.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .word_cache import WordCache, gathered, joined, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
KEPT = 250_000
#: Characters of a word that is relaxed together with others, at most.
LONG = 64
#: Words that are relaxed together.
BATCH = 8192
NEVER = 1 << 40


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 5:
            value, i = struct.unpack_from("<f", data, i)[0], i + 4
        elif kind == 1:
            value, i = struct.unpack_from("<d", data, i)[0], i + 8
        else:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Table:
    """Values of 64-bit keys, looked up many at a time: open addressing in arrays at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int) -> None:
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, missing, np.int64)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # the last of those that meet in a slot stays
            won = free & (self.keys[at] == keys[left])
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        held = self.keys[at]
        left = np.nonzero((held != keys) & (held != -1))[0]
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            out[left] = self.values[at]
            more = (held != keys[left]) & (held != -1)
            left, at = left[more], at[more]
        return out


class Trie:
    """Arcs (state, character) -> state, and the number that each state emits (-1: it is not final)."""

    def __init__(self, strings: Iterable[tuple[str, int]]) -> None:
        arcs: dict[int, int] = {}
        final: dict[int, int] = {}
        for s, number in strings:
            at = 0
            for c in s:
                at = arcs.setdefault(at << 21 | ord(c), len(arcs) + 1)
            final[at] = number
        self.arcs = Table(np.fromiter(arcs, np.int64, len(arcs)), np.fromiter(arcs.values(), np.int64, len(arcs)), -1)
        self.final = np.full(len(arcs) + 1, -1, np.int64)
        self.final[list(final)] = list(final.values())

    def composed(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lattice of texts, given one after the other, and for each character where its text ends: from, to and number of each arc."""
        start, at, length = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        found: list[tuple[np.ndarray, ...]] = [(start[:0],) * 3]
        while len(start):
            at = self.arcs.of(at << 21 | codes[start + length])
            live = at >= 0
            start, at, length = start[live], at[live], length + 1
            number = self.final[at]
            some = number >= 0
            found.append((start[some], start[some] + length, number[some]))
            more = start + length < ends[start]
            start, at = start[more], at[more]
        return tuple(np.concatenate(x) for x in zip(*found))


class Normaliser:
    """A model's rewriting of characters and spaces."""

    def __init__(self, rules: dict[int, object], user: list[str]) -> None:
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if not rules.get(5, 1):
            raise ValueError("a model that does not mark spaces cannot be compiled")
        self.map = self._compiled(rules.get(2) or b"") | {u: u for u in user}
        longest: dict[str, int] = {}
        for key in self.map:
            longest[key[0]] = max(longest.get(key[0], 0), len(key))
        self.longest = longest
        self.first = re.compile(f"[{''.join(map(re.escape, longest))}]") if longest else None

    @staticmethod
    def _compiled(blob: bytes) -> dict[str, str]:
        """The character map: a double array of UTF-8 keys, and then the texts that their values point at."""
        if not blob:
            return {}
        size = struct.unpack_from("<I", blob)[0]
        units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
        offset = (units >> 10) << ((units & 512) >> 6)
        label = units & 0x800000FF
        out: dict[str, str] = {}
        todo, letters = [(int(offset[0]), b"")], np.arange(1, 256)
        while todo:
            at, key = todo.pop()
            near = at ^ letters
            inside = near < len(units)
            for byte in letters[inside][label[near[inside]] == letters[inside]].tolist():
                node = at ^ byte
                below = node ^ int(offset[node])
                if units[node] >> 8 & 1:
                    value = int(units[below]) & 0x7FFFFFFF
                    out[(key + bytes([byte])).decode()] = texts[value : texts.index(b"\0", value)].decode()
                todo.append((below, key + bytes([byte])))
        return out

    def _rewritten(self, text: str) -> Iterator[str]:
        """The outputs of the longest matches, from left to right."""
        if self.first is None:
            yield from text
            return
        i = 0
        while i < len(text):
            for k in range(self.longest.get(text[i], 0), 0, -1):
                if (out := self.map.get(text[i : i + k])) is not None:
                    yield out
                    i += k
                    break
            else:
                yield text[i]
                i += 1

    def __call__(self, text: str) -> str:
        if self.first is None and not self.squeeze:
            out = text
        elif self.squeeze:
            parts, after_space = [], True
            for part in self._rewritten(text):
                if after_space:
                    part = part.lstrip(" ")
                if part:
                    parts.append(part)
                    after_space = part.endswith(" ")
            out = "".join(parts).rstrip(" ")
        else:
            out = "".join(self._rewritten(text))
        if not out and (self.squeeze or not text):
            return ""
        return (MARK if self.prefix else "") + out.replace(" ", MARK)


class PieceFst:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, cached: int = KEPT) -> None:
        pieces: list[tuple[str, float, int]] = []
        rules: dict[int, object] = {}
        trainer: dict[int, object] = {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    rules = dict(_fields(value))
        kind = trainer.get(3, 1)
        if kind not in (1, 2) or trainer.get(24, 0):
            raise ValueError("only unigram and merge models that mark the space before a word can be compiled")
        self.merges, self.pieces = kind == 2, pieces
        self.normaliser = Normaliser(rules, [p for p, _, k in pieces if k == USER])
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        self.kept = WordCache(cached)
        spoken = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.spoken, self.spoken_size = np.frombuffer(b"".join(spoken), np.uint8), np.fromiter(map(len, spoken), np.int64, len(spoken))
        if self.merges:
            self._merge_arcs()
        else:
            self._unigram_arcs()

    # --- compilation ---------------------------------------------------------------------------------------------------

    def _unigram_arcs(self) -> None:
        normal = [s for _, s, k in self.pieces if k == NORMAL]
        self.fallback_weight = _single(min(normal) - 10.0)
        most = max(normal)
        self.weight = [len(p.encode()) * most - 0.1 if k == USER else s for p, s, k in self.pieces]
        self.trie = Trie((p, i) for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER))

    def _merge_arcs(self) -> None:
        """Symbols: the pieces that merges can make, then their characters that are no pieces, then any other character."""
        pieces = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        if any(k in (USER, UNUSED) for _, _, k in self.pieces):
            raise ValueError("merge models with user-defined or unused pieces cannot be compiled")
        if not self.normaliser.prefix:
            raise ValueError("merge models without a space in front cannot be compiled")
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece runs over words")
        self.score = {p: self.pieces[i][1] for p, i in pieces.items()}
        order = sorted((p for p in pieces if len(p) > 1), key=lambda p: -self.score[p])
        split = {p: s for p in order if (s := self._last_merge(p))}  # others never come out of merges
        self.symbols = [p for p in pieces if len(p) == 1 or p in split]
        self.symbols += sorted({c for p in split for c in p} - set(self.symbols))
        number = {p: i for i, p in enumerate(self.symbols)}
        self.other = len(number)
        n = self.other + 1
        self.emits = np.array([pieces.get(p, -1) for p in self.symbols] + [-1])
        self.length = np.array([len(p) for p in self.symbols] + [1])
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        keys, ranks = [], []
        for r, (p, (a, b)) in enumerate(split.items()):
            k = number[p]
            self.rank[k], self.left[k], self.right[k] = r, number[a], number[b]
            for cut in range(1, len(p)):
                if p[:cut] in number and p[cut:] in number:
                    keys.append(number[p[:cut]] << 32 | number[p[cut:]])
                    ranks.append(r)
        self.joint = Table(np.array(keys, np.int64), np.array(ranks, np.int64), NEVER)
        self.trie = Trie(number.items())
        self.number, self.ranks = number, dict(zip(keys, ranks))
        self.tails = {p[k:] for p in split for k in range(len(p))}
        self.pairs: dict[int, bool] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that are joined last when a piece is merged from its characters; None if they do not end in it."""
        parts, score = list(piece), self.score
        while True:
            best = max(((score[m], -i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in score), default=None)
            if best is None:
                return None
            i = -best[1]
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    # --- shortest paths of merge models ----------------------------------------------------------------------------------

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of a's and b's joint text end in a and b, for many pairs of symbols.

        The merges of both are undone, the latest first; a merge over their border that would have come earlier rules the
        pair out.
        """
        x, y, ok = a, b, np.ones(len(a), bool)
        limit, live = np.full(len(a), NEVER), np.arange(len(a))
        while len(live):
            over = self.joint.of(x << 32 | y)
            p, q = self.rank[x], self.rank[y]
            bad = over < limit
            ok[live[bad]] = False
            go = ~bad & (np.maximum(p, q) >= 0)
            live, x, y, p, q = live[go], x[go], y[go], p[go], q[go]
            left = p > q
            limit = np.where(left, p, q + 1)
            x, y = np.where(left, self.right[x], x), np.where(left, y, self.left[y])
        return ok

    def _paths(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the shortest paths of words, given one after the other, and each one's place in them."""
        end = np.cumsum(size)
        word = np.repeat(np.arange(len(size)), size)
        since, to, symbol = self.trie.composed(codes, end[word])
        single = np.ones(len(codes), bool)
        single[since[to - since == 1]] = False
        bare = np.nonzero(single)[0]
        since, to, symbol = np.concatenate([since, bare]), np.concatenate([to, bare + 1]), np.concatenate([symbol, np.full(len(bare), self.other)])
        first = (end - size)[word[since]]
        depth = to - first
        order = np.argsort(depth.astype(np.uint8), kind="stable")
        since, to, symbol, first = since[order], to[order], symbol[order], first[order]
        step = np.searchsorted(depth[order], np.arange(1, int(size.max(initial=0)) + 2))
        # the symbol in which the path to each place ends; place i is before the i-th character or, at a word's end, after it
        last = np.full(len(codes) + 1, -1, np.int64)
        for lo, hi in zip(step.tolist(), step[1:].tolist()):
            a, b, z, own = since[lo:hi], to[lo:hi], symbol[lo:hi], first[lo:hi]
            ok = a == own
            inner = np.nonzero(~ok)[0]
            ok[inner] = self._stand(last[a[inner] - 1], z[inner])
            last[b[ok] - 1] = z[ok]
        out = np.full(len(codes), -1, np.int64)
        at = end[size > 0]
        start = (end - size)[size > 0]
        while len(at):
            out[at - 1] = last[at - 1]
            at = at - self.length[last[at - 1]]
            more = at > start
            at, start = at[more], start[more]
        places = np.nonzero(out >= 0)[0]
        return out[places], places

    def _path(self, s: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of one long word, whose neighbours are looked up one by one."""
        number, tails, other, pairs = self.number, self.tails, self.other, self.pairs
        last: list[int] = [other] * (len(s) + 1)
        for i in range(1, len(s) + 1):
            k, near = i - 2, [(number.get(s[i - 1], other), i - 1)]
            while k >= 0 and (piece := s[k:i]) in tails:
                if piece in number:
                    near.append((number[piece], k))
                k -= 1
            for symbol, k in reversed(near):
                if k:
                    pair = last[k] << 32 | symbol
                    found = pairs.get(pair)
                    if found is None:
                        found = bool(self._stand(np.array([last[k]]), np.array([symbol]))[0])
                        if len(pairs) < 300_000:
                            pairs[pair] = found
                    if not found:
                        continue
                last[i] = symbol
                break
        places, i = [], len(s)
        while i:
            places.append(i)
            i -= int(self.length[last[i]])
        places.reverse()
        return np.array([last[i] for i in places], np.int64), np.array(places, np.int64) - 1

    def _emitted(self, symbol: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, one after the other, and how many each has; codes: each one's last character."""
        ids, count = self.emits[symbol], np.ones(len(symbol), np.int64)
        bare = np.nonzero(ids < 0)[0]
        if not len(bare):
            return ids.astype(np.uint32), count
        spelled = {c: self._bytes(chr(c)) for c in np.unique(codes[bare]).tolist()}
        each = [spelled[c] for c in codes[bare].tolist()]
        count[bare] = [len(e) for e in each]
        at = np.repeat(ids, count)
        at[at < 0] = [i for e in each for i in e]
        return at.astype(np.uint32), count

    def _bytes(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if len(self.byte) == 256 else [self.unknown]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has; a mark stands before each."""
        found = [self._batch(words.slice(i, BATCH)) for i in range(0, len(words), BATCH)]
        return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.uint32), np.zeros(0, np.int64)), *found))

    def _batch(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        size = np.asarray(pc.utf8_length(words)).astype(np.int64) + 1
        long = np.nonzero(size > LONG)[0]
        table = words if not len(long) else pc.if_else(pa.array(size > LONG), "", words)
        codes = _codes(MARK + joined(table, MARK, len(table))[0])
        short = np.where(size > LONG, 1, size)
        symbol, place = self._paths(codes, short)
        ids, count = self._emitted(symbol, codes[place])
        word = np.repeat(np.arange(len(size)), short)[place]
        total = np.bincount(word, count, len(size)).astype(np.int64)
        if not len(long):
            return ids, total
        parts = np.split(ids, np.cumsum(total)[:-1])
        for k in long.tolist():
            s = MARK + words[k].as_py()
            symbol, place = self._path(s)
            parts[k], _ = self._emitted(symbol, _codes(s)[place])
        return np.concatenate(parts), np.array([len(p) for p in parts])

    # --- shortest path of unigram models -----------------------------------------------------------------------------------

    def _unigram(self, s: str) -> list[int]:
        codes = _codes(s)
        n = len(codes)
        since, to, number = self.trie.composed(codes, np.full(n, n))
        single = np.ones(n, bool)
        single[since[to - since == 1]] = False
        bare = np.nonzero(single)[0]
        since, to, number = np.concatenate([since, bare]), np.concatenate([to, bare + 1]), np.concatenate([number, np.full(len(bare), -1)])
        order = np.lexsort((number < 0, to, since))
        best, back = [0.0] + [None] * n, [(0, -1)] * (n + 1)
        weight, fallback = self.weight, self.fallback_weight
        for a, b, i in zip(since[order].tolist(), to[order].tolist(), number[order].tolist()):
            cost = (fallback if i < 0 else weight[i]) + best[a]
            if best[b] is None or cost > best[b]:
                best[b], back[b] = _single(cost), (a, i)
        out, at = [], n
        while at:
            a, i = back[at]
            out.append([i] if i >= 0 else self._bytes(s[a:at]))
            at = a
        return [i for part in reversed(out) for i in part]

    # --- texts ---------------------------------------------------------------------------------------------------------------

    def _without_runs(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A run of unknown ids in a text is one id."""
        if len(self.byte) == 256 or not len(ids):
            return ids, ends
        gone = (ids == self.unknown) & np.concatenate([[False], ids[:-1] == self.unknown])
        starts = np.concatenate([[0], ends[:-1]])
        gone[starts[starts < len(ids)]] = False
        return ids[~gone], ends - np.concatenate([[0], np.cumsum(gone)])[ends]

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = self.merges and self.normaliser.first is None and self.normaliser.prefix and not self.normaliser.squeeze
        if not plain:
            whole = [self.normaliser(t) for t in texts.to_pylist()]
            if not self.merges:
                found = [self._unigram(t) for t in whole]
                ends = np.cumsum([len(f) for f in found])
                return self._without_runs(np.array([i for f in found for i in f], np.uint32), ends)
        # a text's words; each stands after a mark, and further marks before it are part of it
        parts = pc.split_pattern(texts, " ")
        odd = [not plain] * len(texts)
        if plain:
            bare = np.asarray(pc.equal(parts.flatten(), ""))
            edge = np.asarray(parts.offsets) - parts.offsets[0].as_py()
            bare[edge[1:] - 1] = False  # a text's last part may be empty
            odd = (np.add.reduceat(bare, edge[:-1]) > 0).tolist()
            whole = [self.normaliser(t.as_py()) if o else "" for t, o in zip(texts, odd)] if any(odd) else []
        if any(odd):
            lists = [_units(t) if o else p.as_py() for t, o, p in zip(whole, odd, parts)]
            parts = pa.array(lists, pa.list_(pa.string()))
        empty = np.asarray(pc.equal(texts, "")) if plain else np.array([not t for t in whole], bool)
        edge = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        at, names = np.array(coded.indices, np.int64), coded.dictionary
        place = self.kept.places(names)
        missing = np.nonzero(place < 0)[0]
        place[missing] = len(self.kept) + np.arange(len(missing))
        fresh = names.take(pa.array(missing))
        new = self._words(fresh)
        ids, size = np.concatenate([self.kept.ids, new[0]]), np.concatenate([self.kept.size, new[1], [0]])
        rows = place[at]
        rows[edge[:-1][empty & (edge[1:] > edge[:-1])]] = len(size) - 1
        out, end = gathered(ids, size, rows)
        self.kept.keep(fresh, *new, np.bincount(at, minlength=len(names))[missing])
        return self._without_runs(out, np.concatenate([[0], end])[edge[1:]])

    def flat(self, texts: pa.Array | Iterable[str | None], at_once: int = 8_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts in order (unsigned, 32 bits), and where each text ends in them. Null counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        column = pc.fill_null(column, "")
        for i, j in slices(column, at_once):
            yield self._some(column.slice(i, j - i))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        return b"".join(ids.astype("<u4", copy=False).tobytes() for ids, _ in self.flat([text]))

    def said(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts' ids, with the space that normalising put in front, and where each text ends in them."""
        out, end = gathered(self.spoken, self.spoken_size, ids)
        return out, np.concatenate([[0], end])[ends]

    def decode(self, ids: bytes) -> str:
        out, _ = self.said(np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]))
        text = out.tobytes().decode("utf-8", "replace")
        if self.normaliser.squeeze:
            return text.lstrip(" ")
        return text[1:] if self.normaliser.prefix and text.startswith(" ") else text


def _units(text: str) -> list[str]:
    """Runs of marks and what follows, without the first mark."""
    return [u[1:] for u in UNIT.findall(text)]


def _single(x: float) -> float:
    """x in single precision."""
    return struct.unpack("f", struct.pack("f", x))[0]


_MADE: dict[str, PieceFst] = {}


def piece_fst(path: str) -> PieceFst:
    """One per worker process."""
    if path not in _MADE:
        _MADE[path] = PieceFst(path)
    return _MADE[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def encoded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit bytes) of each row."""
    small_batches(docs.sparkSession)
    model = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = piece_fst(model)
        for batch in batches:
            at = 0
            for ids, ends in fst.flat(batch.column(1)):
                raw, edge = ids.astype("<u4", copy=False).tobytes(), [0, *(4 * ends).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ends)), pa.array([raw[a:b] for a, b in zip(edge, edge[1:])], pa.binary())], ["doc_id", "ids"])
                at += len(ends)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    model = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = piece_fst(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fst.decode(i or b"") for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _same(fst: PieceFst, texts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bool]:
    """Whether decoding gives each text back."""
    out, stop = fst.said(ids, ends)
    raw, start, same = memoryview(out), 0, []
    for text, end in zip(texts, stop.tolist()):
        own = text.as_buffer() if text.is_valid else b""
        at = start + 1 if fst.normaliser.prefix and end > start and raw[start] == 32 else start
        same.append(raw[at:end] == memoryview(own or b"").cast("B"))
        start = end
    return same


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (whether decoding gives the text back) of each row, in one pass."""
    small_batches(docs.sparkSession)
    model = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = piece_fst(model)
        for batch in batches:
            at = 0
            for ids, ends in fst.flat(batch.column(1)):
                raw, edge = memoryview(ids.astype("<u4", copy=False)).cast("B"), [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(edge, edge[1:])]
                same = _same(fst, batch.column(1).slice(at, len(ends)), ids, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ends)), pa.array(np.diff(ends, prepend=0)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "round_trip"])
                at += len(ends)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
