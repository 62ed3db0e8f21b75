from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pytest

from helpers import bag, documents, empty
from pebblegraph.llm import sharding


def plain_directory(rows, limit):
    """Split the fullest buckets bit by bit until all fit, or their key has no more bits of difference."""
    buckets, done = {"": list(rows)}, {}
    while buckets:
        name, own = buckets.popitem()
        if sum(n for _, n in own) <= limit or len({h for h, _ in own}) == 1:
            done[name] = own
            continue
        halves = defaultdict(list)
        for h, n in own:
            halves[name + format(h, "060b")[len(name)]].append((h, n))
        buckets |= halves
    return {h: (name, sum(n for _, n in own)) for name, own in done.items() for h, n in own}


@pytest.mark.parametrize("limit", [2_000, 20_000, 100_000, 1 << 30])
def test_only_oversized_buckets_split(spark, tables, limit):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = sharding.assigned(docs, limit).collect()
    want = plain_directory([(r["h"], r["n_bytes"]) for r in got], limit)
    assert {r["h"]: (r["shard"], r["shard_bytes"]) for r in got} == want
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["n_bytes"]
        assert r["oversize"] == (r["n_bytes"] > limit)
    assert all(r["shard_bytes"] == sizes[r["shard"]] and (sizes[r["shard"]] <= limit or r["oversize"]) for r in got)


def test_the_sql_splits_alike(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    got = sharding.assigned(spark.read.parquet(f"{tables}/documents.parquet"), 9_000).drop("h").collect()
    assert bag(got) == bag(con.execute(sharding.oracle(9_000)).fetchall())


def test_odd_rows_and_equal_rows(spark):
    docs = documents(spark)
    got = sharding.assigned(docs, 1000)
    assert bag(got.select("doc_id", "n_bytes").collect()) == bag(docs.selectExpr("doc_id", "coalesce(octet_length(text), 0)").collect())
    assert sharding.assigned(empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "x" * 100)] * 95 + [(2, "y" * 500)] * 3, "doc_id long, text string")
    rows = sharding.assigned(same, 450).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["n_bytes"]
    assert len(rows) == 98 and all(sizes[r["shard"]] == r["shard_bytes"] for r in rows)
    assert all(r["shard_bytes"] <= 450 for r in rows if r["doc_id"] == 1)
    assert all(r["oversize"] and r["shard_bytes"] == 500 for r in rows if r["doc_id"] == 2)
    with pytest.raises(ValueError, match="byte"):
        sharding.assigned(docs, 0)


def test_shards_as_folders(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    sharding.write_shards(docs, f"file://{tmp_path}/s", 50_000)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert bag(back.select(docs.columns).collect()) == bag(docs.collect())
    assert back.groupBy("_shard").agg({"text": "count"}).count() > 3


def test_folders_of_equal_rows_hold_the_limit(spark, tmp_path):
    same = spark.createDataFrame([(1, "x" * 100, i) for i in range(95)] + [(2, "y" * 500, 0)] * 3 + [(3, None, 1), (4, "z", 2)], "doc_id long, text string, other long")
    sharding.write_shards(same, f"file://{tmp_path}/s", 450)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert bag(back.select(same.columns).collect()) == bag(same.collect())
    sizes, want = Counter(), Counter()
    for r in back.collect():
        sizes[r["_shard"]] += len(r["text"] or "")
    for r in sharding.assigned(same, 450).collect():
        want["s" + r["shard"].replace("/", "-")] += r["n_bytes"]
    assert sizes == want and max(sizes.values()) == 500 and len(sizes) >= 27


def test_no_python_in_the_plan(spark, tables):
    plan = sharding.assigned(spark.read.parquet(f"{tables}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
