from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from helpers import bag, components, documents, empty
from pebblegraph.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text: str | None) -> int:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps: dict) -> dict:
    """id -> smallest id in reach, by comparing every pair of ids."""
    ids = sorted(fps)
    return components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])


@pytest.mark.parametrize("text", [None, "", " ", "one", "One TWO", "a b c", "a b c a b c a b c", "É é İ I", "x y z", "tab\tnew\nline\x0bv\x0cf\rr"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_the_embedding_bounds_the_distance_from_below(spark):
    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(300)]
    values += [v ^ sum(1 << r.randrange(64) for _ in range(3)) for v in values]
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = [x[0] & (1 << 64) - 1 for x in df.select(simhash.embedded(df["fp"])).collect()]
    assert got == simhash.points_of(np.array(values, np.uint64)).tolist()
    coordinates = lambda p: [{0: 0, 1: 1, 3: 2}[p >> 2 * i & 3] for i in range(32)]
    assert [coordinates(g) for g in got] == [[(v >> 2 * i & 3).bit_count() for i in range(32)] for v in values]
    for a, b, x, y in zip(values, values[1:], got, got[1:]):
        assert sum(abs(p - q) for p, q in zip(coordinates(x), coordinates(y))) == (x ^ y).bit_count() <= (a ^ b).bit_count()


@pytest.mark.parametrize("chunk", [8, 8192])
def test_links_connect_what_a_comparison_of_all_pairs_connects(spark, chunk):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values):  # chains: each step within reach, the ends are not
        for _ in range(r.randint(0, 6)):
            v ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
            values.add(v)
    values = sorted(values)
    points = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(points, chunk=chunk).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in got)
    all_links = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert all_links and components(values, got) == components(values, all_links)


def test_a_crowded_cell_is_chunked(spark):
    base = 0x0123456789ABCDEF
    values = [base ^ 1 << i ^ 1 << j for i in range(12) for j in range(i)]
    points = spark.createDataFrame([(v,) for v in values], "fp long")
    got = components(values, simhash.links(points, chunk=10).collect())
    assert set(got.values()) == set(components(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]).values())


def test_the_query_equals_brute_force(spark, tables):
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    groups = plain_groups(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, tables).collect()}
    assert got == {i: (format(fps[i], "016x"), groups[i]) for i in fps}
    assert len(set(groups.values())) < len(groups)


def test_odd_rows(spark):
    docs = documents(spark)
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows if r["doc_id"] is not None}
    groups = plain_groups(fps)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == groups
    assert groups[2] == 1 and groups[5] == groups[6] == 4 and groups[15] == 14
    null = simhash.near_duplicates(docs.where("doc_id is null and text is null")).collect()
    assert [tuple(r) for r in null] == [(None, "0" * 16, None)] * 2
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    ids = [r["doc_id"] for r in rows]
    groups = plain_groups({r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect() if r["doc_id"] is not None})
    assert sorted(i for i in ids if i is not None) == sorted(set(groups.values())) and ids.count(3) == (groups[3] == 3)
    assert {r["_k1"] for r in rows} == {9}, "a column of the table with a name that the operator uses inside"
    assert not bag(rows) - bag(docs.collect())
    assert simhash.deduplicated(empty(spark)).count() == 0


def test_of_rows_equal_in_id_and_text_the_same_one_stays(spark):
    rows = [(1, "a text of some words", f"s{i}") for i in range(20)] + [(2, "another text of some words", None)]
    kept = [simhash.deduplicated(spark.createDataFrame(some, "doc_id long, text string, source string").repartition(5)).collect() for some in (rows, rows[::-1])]
    assert bag(kept[0]) == bag(kept[1]) and len(kept[0]) == 2
