from __future__ import annotations

import numpy as np
import pytest

from helpers import components
from pebblegraph.llm import cross_polytope, queries


def plain(rows, cosine=0.98):
    """id -> (links, smallest id in reach), by all pairs. rows: (id, vector, label)."""
    good = [(i, np.array(v, float), k) for i, v, k in rows if v is not None and k is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = []
    for a, (i, x, k) in enumerate(good):
        for j, y, l in good[a + 1 :]:
            if k == l and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links.append((i, j))
    count = {i: 0 for i, *_ in rows}
    for i, j in links:
        count[i] += 1
        count[j] += 1
    reach = components(count, links)
    return {i: (count[i], reach[i]) for i in count}


def near_pairs(n, cosine, width=64, seed=3):
    """Pairs of unit vectors at one cosine."""
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(2, n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def test_the_fast_transform_is_the_hadamard_matrix():
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(cross_polytope.hadamard(x), x @ h / 4)


@pytest.mark.parametrize("cosine", [0.9801, 0.985, 0.995])
def test_recall_at_the_limit(cosine):
    a, b = near_pairs(3000, cosine)
    p, q = (cross_polytope.bucket_keys(x).reshape(len(x), -1) for x in (a, b))
    assert (p[:, :, None] == q[:, None, :]).any(axis=(1, 2)).mean() >= 0.9


def test_the_query_against_brute_force(spark, tables):
    tables = tables.replace("sf0.001", "sf0.1")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    want = plain(rows)
    got = {r["vec_id"]: r for r in queries.op9_embeddings(spark, tables).collect()}
    assert got.keys() == want.keys()
    assert all(got[i]["n_links"] <= want[i][0] for i in want)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert sum(got[i]["component_id"] == want[i][1] for i in want) >= 0.95 * len(want)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


@pytest.mark.parametrize("chunk", [7, 4096])
def test_copies_and_chunks_count_each_link_once(spark, chunk):
    a, b = near_pairs(6, 0.999, seed=8)
    rows = [(10 * i + j, (v * (1 + j)).tolist(), i % 2) for i, v in enumerate(a) for j in range(3)] + [(100 + i, v.tolist(), i % 2) for i, v in enumerate(b)]
    rows += [(200 + i, a[0].tolist(), 0) for i in range(30)] + [(300 + i, a[0].tolist(), 1) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cross_polytope.near_duplicates(df, chunk=chunk).collect()}
    assert got == plain(rows)


def test_odd_vectors_link_with_nothing(spark):
    one, inf, nan = [1.0, 2.0, 3.0], float("inf"), float("nan")
    rows = [(1, one, 1), (2, one, 1), (3, one, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, inf, 3.0], 1), (9, [nan, 1.0, 1.0], 1), (10, [], 1), (11, [1.0, 2.0, 3.0, 0.0], 1), (12, one, 2), (13, [2.0, 4.0, 6.0], 1), (14, [-1.0, -2.0, -3.0], 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, mark string, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cross_polytope.near_duplicates(df).collect()}
    four = {1: True, 2: False, 11: False, 13: False}
    assert got == {i: (3, 1, four[i]) if i in four else (0, i, True) for i, *_ in rows}
    assert cross_polytope.near_duplicates(df.where("false")).count() == 0
    twice = cross_polytope.near_duplicates(df.where("vec_id = 12").union(df.where("vec_id = 12"))).collect()
    assert [tuple(r) for r in twice] == [(12, 1, 12, True)] * 2


def test_repeated_null_ids_and_long_vectors(spark):
    r = np.random.default_rng(8)
    long = r.normal(size=(4, 5000))
    long[1] = long[0] + 0.01 * r.normal(size=5000)
    short = r.normal(size=3).tolist()
    rows = [(i, v.tolist(), 1) for i, v in enumerate(long)] + [(None, short, 2)] * 3 + [(None, None, None)] * 2
    got = sorted(cross_polytope.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect(), key=repr)
    assert sorted((x["vec_id"] is None, x["n_links"]) for x in got) == [(False, 0), (False, 0), (False, 1), (False, 1), (True, 0), (True, 0), (True, 2), (True, 2), (True, 2)]
    assert {x["vec_id"]: x["component_id"] for x in got if x["vec_id"] is not None} == {0: 0, 1: 0, 2: 2, 3: 3}
