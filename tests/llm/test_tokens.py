"""Packing (op3), piece transducers (op5) and token files (op6) against the tokenizers' own libraries."""

from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import LONG, documents, empty
from pebblegraph.llm import byte_bpe, packing, piece_fst, queries, simple8b, token_files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(byte_bpe.default_path())
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_fst.default_path())


def ids_of(tokenizer, text) -> bytes:
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


ODD = ["", " ", "  a", "a  ", "a \n b", "\n\n", "a b 　c", "<|endoftext|> x<|endoftext|>", "don't I'll we've", "é🙂日本語 ß", "a,b c. d; 12 345", "\x00\x01", "tab\tx\t\ty", "x" * 5000, "word\nnext word\n", " lead", "trail ", "\r\n a", "ŉa İ ǆ"]


def test_byte_ids_of_odd_texts(tokenizer):
    for texts in (ODD, *[[t] for t in ODD], [a + b for a in ODD[:-1] for b in ODD[:8]]):
        assert list(byte_bpe.byte_bpe(byte_bpe.default_path()).encode(texts)) == [ids_of(tokenizer, t)[:-4] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.text(" ab\n\t,.'s1é", max_size=40), min_size=1, max_size=4))
def test_byte_ids_of_any_texts(texts):
    bpe = byte_bpe.byte_bpe(byte_bpe.default_path())
    assert list(bpe.encode(texts)) == [np.array(x.ids, "<u4").tobytes() for x in bpe.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_a_cut_text_and_an_empty_one():
    own = byte_bpe.ByteBpe(byte_bpe.default_path())
    texts = ["x y", "a  .,1\tab", "a .,1\tab  ", ".,1\tab", " "]
    assert list(own.encode(texts)) == [np.array(x.ids, "<u4").tobytes() for x in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    ids, size = own._new(pa.array([".,1\tab", "x"]))
    want = [own.tokenizer.encode(f" {w}", add_special_tokens=False).ids for w in (".,1\tab", "x")]
    assert ids.tolist() == sum(want, []) and size.tolist() == [len(w) for w in want]


def test_cached_words_keep_their_ids():
    own = byte_bpe.ByteBpe(byte_bpe.default_path(), cached=3)
    texts = ["a b b c c", "d d b c e e", "e d c b a", " b", "c "]
    for _ in range(2):
        assert list(own.encode(texts, 12)) == [np.array(x.ids, "<u4").tobytes() for x in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert len(own.kept) == len(own.kept.size) == 3


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40) | st.text(" abcdeilnorst\n\t,.é", max_size=60))
def test_piece_ids_of_any_text(text):
    import sentencepiece

    own = piece_fst.piece_fst(piece_fst.default_path())
    sp = _SP.setdefault("sp", None) or _SP.update(sp=sentencepiece.SentencePieceProcessor(model_file=piece_fst.default_path())) or _SP["sp"]
    ids = own.encode(text)
    if "\x00" not in text:
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text)
    if "▁" not in text:
        assert own.decode(ids) == text


_SP: dict = {}


def test_piece_digests_over_the_table(spark, tables, pieces):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_ids"], r["ids_crc32"], r["round_trip"]) for r in queries.op5_pieces(spark, tables).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = np.array(pieces.encode(r["text"] or ""), "<u4")
        assert got[r["doc_id"]] == (len(ids), zlib.crc32(ids.tobytes()), True)


def field(number: int, value) -> bytes:
    """A field of a protocol buffer."""

    def varint(v: int) -> bytes:
        out = bytearray()
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        return bytes([*out, v])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_file(path, merges: bool, pieces, rules=b"") -> str:
    """A model of (piece, score, kind) without training. rules: more fields of the normaliser."""
    kinds = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in [*kinds, *pieces])
    trainer = field(3, 2 if merges else 1) + (field(35, 1) if any(k == 6 for *_, k in pieces) else b"")
    path.write_bytes(data + field(2, trainer) + field(3, field(1, b"own") + rules))
    return str(path)


BYTES = [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
#: Without its character map, spaces kept.
KEEP_SPACES = field(4, 0)
UNIGRAMS = [(p, -1.0 - 0.37 * i, 1) for i, p in enumerate(["▁", "a", "b", "c", "ab", "ba", "▁a", "▁ab", "abc", "cab", "bb", "aa", "▁▁", "é", "日本", "b▁a", "d"])]


def folding() -> bytes:
    """The character map that the original has built in for its widest rule."""
    import sentencepiece

    found = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()
    return next(value for number, value in piece_fst._fields(next(v for n, v in piece_fst._fields(found) if n == 3)) if number == 2)


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("spaces", ["kept", "squeezed", "folded", "bare"])
@pytest.mark.parametrize("kind", ["unigram", "user", "merges"])
def test_ids_of_models_made_here(tmp_path, kind, spaces, fallback):
    import sentencepiece

    if kind == "merges" and spaces == "bare":
        return
    rules = {"kept": KEEP_SPACES, "squeezed": b"", "folded": field(2, folding()), "bare": field(3, 0) + KEEP_SPACES}[spaces]
    if kind == "merges":
        pieces = [(p, -float(i), 1) for i, p in enumerate(["ab", "▁a", "aa", "▁ab", "abc", "ba", "▁▁", "bab", "abab", "▁▁a"])] + [(p, -50.0 - i, 1) for i, p in enumerate("▁abcé")]
    else:
        pieces = UNIGRAMS + ([("AB", 0.0, 4), ("bab", 0.0, 4)] if kind == "user" else [])
    path = model_file(tmp_path / "m.model", kind == "merges", pieces + (BYTES if fallback else []), rules)
    own, sp = piece_fst.PieceFst(path, cached=20), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    letters = "aaabbbcc   dé日本ABﬁ①½\u00a0\u3000\tÅÄ¡x"
    texts = ["", " ", "   ", "a", " a ", "a  b", *("".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(400)), "ab" * 300 + " c" * 100]
    want = [sp.encode(t) for t in texts]
    for at_once in (50, 10**6):
        got = [part.tolist() for ids, ends in own.flat(texts, at_once) for part in np.split(ids, ends[:-1])]
        assert [(t, g) for t, g in zip(texts, got)] == list(zip(texts, want))
    if fallback:
        for t, ids in zip(texts, want):
            assert own.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids), t


def test_models_that_are_refused(tmp_path):
    path = tmp_path / "m.model"
    merges = [("a", 0.0, 1), ("▁", 0.0, 1)]
    for made, why in [((True, [*merges, ("b", 0.0, 4)]), "user"), ((True, [*merges, ("a▁a", 0.0, 1)]), "over words"), ((True, merges, field(3, 0)), "in front"), ((False, merges, field(5, 0)), "mark spaces")]:
        with pytest.raises(ValueError, match=why):
            piece_fst.PieceFst(model_file(path, *made))


def test_long_words_take_the_same_path(pieces):
    own = piece_fst.piece_fst(piece_fst.default_path())
    r = random.Random(3)
    for n in (62, 63, 64, 65, 500):
        text = "".join(r.choice("etaoinshrdlu日é") for _ in range(n))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == pieces.encode(text)
        symbol, place = own._path(piece_fst.MARK + text)
        assert own._emitted(symbol, piece_fst._codes(piece_fst.MARK + text)[place])[0].tolist() == pieces.encode(text)


def test_piece_odd_rows(spark):
    docs = documents(spark)
    got = piece_fst.digests(docs).collect()
    assert len(got) == docs.count() and all(r["round_trip"] for r in got)
    back = piece_fst.decoded(piece_fst.encoded(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert piece_fst.digests(empty(spark)).count() == 0


# --- Simple-8b -------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 1 << 17), st.integers(0, (1 << 64) - 1)), max_size=400), st.integers(1, 70))
def test_words_decode_to_the_ids(values, block):
    ids = np.array(values, np.uint64)
    words, first = simple8b.encode(ids, block)
    assert (simple8b.decode(words, first, len(ids), block) == ids).all()
    for b in range(len(first) - 1):  # each block by itself
        part = ids[b * block : (b + 1) * block]
        assert (simple8b.decode(words[first[b] : first[b + 1]], first[:0], len(part), block) == part).all()


def test_small_ids_take_few_bits():
    assert len(simple8b.encode(np.ones(600, np.uint64), 600)[0]) == 10
    assert len(simple8b.encode(np.full(512, 50_000, np.uint64))[0]) == -(-512 // 3)  # 20 bits each
    assert len(simple8b.encode(np.full(4, 1 << 63, np.uint64))[0]) == 8  # escapes


def test_segments():
    lengths, ids = simple8b.unpack(simple8b.pack(np.array([2, 0, 1]), np.array([5, 70_000, 0])))
    assert lengths.tolist() == [2, 0, 1] and ids.tolist() == [5, 70_000, 0]
    assert simple8b.unpack(simple8b.pack(np.zeros(0), np.zeros(0)))[1].tolist() == []
    with pytest.raises(ValueError, match="segment"):
        simple8b.unpack(b"nothing of the kind")


# --- token files -----------------------------------------------------------------------------------------------------


def test_token_files_over_the_table(spark, tables, tokenizer):
    rows = sorted(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect())
    want, at = {}, 0
    for r in rows:
        ids = ids_of(tokenizer, r["text"])
        want[r["doc_id"]] = (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op6_token_files(spark, tables).collect()} == want


def test_token_files_of_odd_rows(spark, tmp_path, tokenizer):
    docs = documents(spark)
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(docs, path, segment_ids=1000)
    got = token_files.read_tokens(spark, path).collect()
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[:3] == [None] * 3 and order[3:] == sorted(order[3:])
    want = sorted((r["doc_id"] or 0, zlib.crc32(ids_of(tokenizer, r["text"]))) for r in docs.collect())
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in got) == want
    whole = {r["doc_id"]: r["ids"] for r in token_files.decoded(spark.read.parquet(path)).where("doc_id in (10, 11, 12)").collect()}
    assert whole == {r["doc_id"]: ids_of(tokenizer, r["text"]) for r in docs.where("doc_id in (10, 11, 12)").collect()}
    assert len(whole[10]) // 4 > LONG
    same = documents(spark).where("doc_id = 12").select("doc_id", "text").crossJoin(spark.range(50).select())
    token_files.write_tokens(same, f"{path}1", segment_ids=100)
    each = {r["start"]: r["n_tokens"] for r in token_files.read_tokens(spark, f"{path}1").collect()}
    size = next(iter(each.values()))
    assert each == {i * size: size for i in range(50)}
    token_files.write_tokens(empty(spark), f"{path}2")
    assert token_files.read_tokens(spark, f"{path}2").count() == 0


# --- packing ---------------------------------------------------------------------------------------------------------


def plain_first_fit(lengths, size):
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b in bins:
            if sum(lengths[j] for j in b) + lengths[i] <= size:
                b.append(i)
                break
        else:
            bins.append([i])
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_the_tree_finds_the_first_bin_that_fits(lengths):
    bins = packing.first_fit_decreasing(lengths, 50)
    assert bins == plain_first_fit(lengths, 50)
    pieces = packing.filled_up(bins, lengths, 50)
    used = [sum(n for *_, n in b) for b in pieces]
    assert sum(used) == sum(lengths) and all(u == 50 for u in used[:-1]) and all(0 < u <= 50 for u in used)


def held(rows, want: dict, size: int):
    """Pieces are whole, gapless and right. want: (doc_id, tokens, checksum of all ids) -> ids."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= size
    for d, ids in want.items():
        own = sorted(docs[d], key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    return len(sequences)


def test_packing_over_the_table(spark, tables, tokenizer):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: ids_of(tokenizer, r["text"]) for r in rows}
    got = queries.op3_packing(spark, tables).collect()
    assert {r["doc_id"] for r in got} == want.keys()
    total = sum(len(x) // 4 for x in want.values())
    assert held(got, want, 1024) <= -(-total // 1024) + 1


def test_packing_of_odd_rows_in_small_groups(spark, tokenizer):
    docs = documents(spark)
    want = {r["doc_id"]: ids_of(tokenizer, r["text"]) for r in docs.collect() if r["doc_id"] not in (None, 3)}
    got = packing.pack(docs, size=64, group=5).collect()
    held([r for r in got], want, 64)
    assert sum(r["length"] for r in got) == sum(len(ids_of(tokenizer, r["text"])) // 4 for r in docs.collect())
    again = packing.pack(docs.repartition(7), size=64, group=5).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert packing.pack(empty(spark)).count() == 0


def test_random_groups_leave_little_padding():
    r = random.Random(2)
    lengths = [r.randint(1, 1023) for _ in range(2048)]
    bins = packing.first_fit_decreasing(lengths, 1024)
    assert len(packing.filled_up(bins, lengths, 1024)) == -(-sum(lengths) // 1024)
