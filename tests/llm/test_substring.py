from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from helpers import bag, documents, empty, words
from pebblegraph.llm import queries, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts: list[str | None], window: int) -> list[tuple[list[str], list[bool]]]:
    """Words of each text and whether each goes, from a table of all windows."""
    split = [WORD.findall(t or "") for t in texts]
    where = defaultdict(list)
    for d, w in enumerate(split):
        for i in range(len(w) - window + 1):
            where[tuple(w[i : i + window])].append((d, i))
    gone = [[False] * len(w) for w in split]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + window] = [True] * window
    return list(zip(split, gone))


def held_against(spark, texts, window=35, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.without_repeats(docs, window=window, **how).select("row.doc_id", "text", "n_words", "n_removed").collect()}
    assert len(got) == len(texts)
    for d, (w, gone) in enumerate(plain(texts, window)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(w), sum(gone)), d
        assert got[d]["text"] == (kept if any(gone) else texts[d]), d


SHARED = " ".join(words(50, 9))
TEXTS = [
    SHARED, "a " + SHARED + " b", SHARED + " " + SHARED, None, "", " ".join(words(34, 1)), " ".join(words(35, 1)), " ".join(words(36, 1)),
    "x " * 34, "x " * 35, "x " * 36, "y " * 200, "ab " * 150, "a b " * 60, "a\tb\n" * 60, " ".join(words(3000, 2, 3)), SHARED.upper(), " ".join(SHARED.split()[5:45]),
]


@pytest.mark.parametrize("how", [{}, {"block_bytes": 200, "range_bytes": 300}, {"gram": 1}, {"gram": 35, "block_bytes": 1000}])
def test_windows_of_35_words(spark, how):
    held_against(spark, TEXTS, **how)


def test_short_windows(spark):
    held_against(spark, TEXTS[:8] + ["a b c d a b c", "c d a", "d a b"], window=3, gram=2, block_bytes=400, range_bytes=100)


def test_a_window_that_every_document_has(spark):
    held_against(spark, [f"own{i} " + SHARED + f" end{i} " + " ".join(words(40, 100 + i, 10**6)) for i in range(200)], block_bytes=2000, range_bytes=2000)


def plan_of(texts, window, gram, bits) -> list[list[bool]]:
    """The two rounds without Spark: each text is a block of its own."""
    blocks = [substring.Block([t], window, gram) for t in texts]

    def told(number, keys):
        asked = pa.concat_tables([substring._asked(i, k, bits) for i, k in enumerate(keys)])
        answers = [substring._answered(number)(asked.filter(pa.compute.equal(asked["part"], p))) for p in set(asked["part"].to_pylist())]
        answers = pa.concat_tables(answers or [substring._TELL.empty_table()])
        return [substring._flags(answers.filter(pa.compute.equal(answers["block"], i)), number, k) for i, k in enumerate(keys)]

    at = [b.suspects(f) for b, f in zip(blocks, told(1, [b.minimisers for b in blocks]))]
    keys = [b.windows(a) for b, a in zip(blocks, at)]
    return [b.covered(a, k, f).tolist() for b, a, k, f in zip(blocks, at, keys, told(2, keys))]


@pytest.mark.parametrize("bits", [0, 3, 20, 30])
@pytest.mark.parametrize("short", [(), (0,), (1,)])
def test_either_half_of_a_window_may_collide(monkeypatch, bits, short):
    """With only 4 bits of one half of the window's hash left, the other half still tells windows apart."""
    whole = substring.Block._hash
    monkeypatch.setattr(substring.Block, "_hash", lambda self, at, length, half: whole(self, at, length, half) & np.uint64(0xF << 60 if half in short and length == 35 else (1 << 64) - 1))
    texts = [" ".join(words(700, i, 3)) + " " + SHARED for i in range(6)] + [" ".join(words(300, 50 + i, 10**6) + words(12, 7) + words(40, 60 + i, 10**6)) for i in range(8)]
    assert plan_of(texts, 35, 12, bits) == [gone for _, gone in plain(texts, 35)]


def test_work_of_a_block_does_not_grow_with_the_ranges():
    keys = substring.Keys(np.random.default_rng(1).integers(0, 1 << 64, 58_000, np.uint64))
    for bits in (0, 10, 16, 20, 30):
        asked = substring._asked(3, keys, bits)
        part = asked["part"].to_numpy()
        assert len(np.unique(part)) == len(part) <= min(1 << bits, 58_000)
        assert b"".join(asked["keys"].to_pylist()) == keys.columns[0].tobytes()


def test_the_query_equals_brute_force(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, (w, gone) in zip(rows, plain([r["text"] for r in rows], 35)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[r["doc_id"]] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op4_substring(spark, tables).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_odd_rows(spark):
    docs = documents(spark)
    got = substring.without_repeats(docs)
    assert bag(got.select("row.doc_id", "row.row", "row.block", "row.part").collect()) == bag(docs.select("doc_id", "row", "block", "part").collect())
    by = {r["doc_id"]: r for r in got.select("row.doc_id", "text", "n_words", "n_removed").collect()}
    assert by[4]["text"] is None and by[5]["text"] == "" and by[6]["text"] == " \n\t "
    assert by[1]["n_removed"] == by[2]["n_removed"] == 160 and by[1]["text"] == ""
    assert by[10]["n_removed"] == by[11]["n_removed"] == 0
    assert substring.without_repeats(empty(spark)).count() == 0
    assert substring.without_repeats(docs.select("text")).count() == docs.count()
    assert substring.without_repeats(spark.range(3).selectExpr("id AS doc_id", "string(id) AS text")).count() == 3, "columns without nulls"


def test_the_automaton_gives_matching_statistics():
    reference = [words(80, 1, 5), words(60, 2, 5), ["only"]]
    a = substring.SuffixAutomaton()
    for r in reference:
        a.add(w.encode() for w in r)
    text = words(70, 3, 5) + reference[0][10:40] + ["only", "only"]
    inside = {tuple(r[i:j]) for r in reference for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    want = [max((n for n in range(1, e + 2) if tuple(text[e + 1 - n : e + 1]) in inside), default=0) for e in range(len(text))]
    assert list(a.matches(w.encode() for w in text)) == want


def test_reference_spans_are_the_maximal_passages(spark):
    reference = spark.createDataFrame([(SHARED,), (" ".join(words(70, 11)),), (None,), ("",)], "text string")
    docs = spark.createDataFrame([(1, "a " + SHARED + " b"), (2, " ".join(words(70, 11)[3:39])), (3, " ".join(words(70, 11)[3:37])), (4, None), (5, "")], "doc_id long, text string")
    for shard in (10, 200_000):
        got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substring.reference_spans(docs, reference, shard_words=shard).collect()}
        assert got == {1: [(1, 51)], 2: [(0, 36)], 3: [], 4: [], 5: []}
    with pytest.raises(ValueError, match="at most"):
        substring.reference_spans(docs, reference, most_words=100)
