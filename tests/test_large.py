"""Steps that must not grow faster than their input, on tables small enough to know the answer."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pebblegraph.operators import neighbours


def listed(rows, k):
    """The k best of each vector by sums in order; null products go last."""
    out = []
    for g, i, x in rows:
        best = []
        for h, j, y in rows:
            if g == h and g is not None and i != j:
                bad = x is None or y is None or None in x or None in y or len(x) != len(y)
                w = None
                if not bad:
                    w = 0.0
                    for a, b in zip(x, y):
                        w += a * b
                    w = round(w, 6)
                best.append((w is None, 0.0 if w is None else -w, j, w))
        out += [(g, i, j, w) for _, _, j, w in sorted(best)[:k]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 8192])
def test_nearest_of_blocks_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    r = np.random.default_rng(5)
    rows = [(int(i % 2), i, [float(v) for v in r.integers(-8, 8, 4) / 7]) for i in range(40)]
    rows += [(0, 100 + i, rows[0][2]) for i in range(12)] + [(1, 200, None), (1, 201, [1.0, None, 0.0, 0.0]), (1, 202, [1.0, 2.0]), (None, 203, [1.0] * 4), (2, 204, [1.0]), (1, 205, [1e200, 0.5, 0.0, 0.0]), (3, 206, None), (3, 207, [1.0])]
    df = spark.createDataFrame(rows, "graph_id long, node_id long, x array<double>")
    got = [tuple(x) for x in neighbours.best_dots(df, 5).select("graph_id", "src", "dst", "weight").collect()]
    want = listed(rows, 5)
    assert [x[:3] for x in sorted(got, key=repr)] == [x[:3] for x in want]
    assert [x[3] for x in sorted(got, key=repr)] == pytest.approx([x[3] for x in want])


def test_nearest_pairs_are_not_listed_one_by_one(spark, tables):
    """No plan of the nearest neighbours holds a join of a label with itself."""
    from pebblegraph.sources import tables as t

    plan = t.nearest(spark, tables).edges._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


def test_orders_are_dealt_over_tasks_in_proportion(spark, tmp_path, monkeypatch):
    """No task meets more than its share of the lines, whatever the session's shuffle partitions are."""
    from pebblegraph.sources import tables as t

    lines = [(o, (o * 7 + i * i) % 23 if i else None, 0) for o in range(200) for i in range(5)] + [(None, 1, 0), (None, 2, 0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(t, "LINES", 100)
    e = t._co_occurrence(spark, str(tmp_path), "l_partkey", 1)
    assert "RepartitionByExpression [l_orderkey" in (plan := e._jdf.queryExecution().optimizedPlan().toString()) and ", 11" in plan
    want = {}
    for o in range(200):
        keys = {k for p, k, _ in lines if p == o and k is not None}
        for a in keys:
            for b in keys - {a}:
                want[a, b] = want.get((a, b), 0.0) + 1
    assert {(r.src, r.dst): r.weight for r in e.collect()} == want and e.count() == len(want)


def test_pairs_are_counted_over_tasks_in_proportion(spark, tmp_path, monkeypatch):
    """No task counts more than its share of the pairs, whatever the session's shuffle partitions (4 here) are."""
    from pebblegraph.sources import tables as t

    lines = [(o, o * 10 + i % 5) for o in range(200) for i in range(7)] + [(o, 5) for o in range(200)] + [(900, 5), (None, 1), (901, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(t, "LINES", 100)
    e = t._co_occurrence(spark, str(tmp_path), "l_suppkey", 1)
    want = {}
    for o in range(200):
        keys = {k for p, k in lines if p == o}
        for a in keys:
            for b in keys - {a}:
                want[a, b] = want.get((a, b), 0.0) + 1
    assert {(r.src, r.dst): r.weight for r in e.collect()} == want and e.count() == len(want)
    shares = [r["count"] for r in e.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 12 and max(shares) < sum(shares) / 6


def test_degrees_read_edges_that_are_made_once(spark):
    from pebblegraph.operators import ops

    made = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    e = spark.createDataFrame([(0, 0, 1, 4.0), (0, 1, 0, 4.0)], "graph_id long, src long, dst long, weight double").mapInArrow(tell, "graph_id long, src long, dst long, weight double")
    assert [r.weight for r in ops.degree_normed(e).collect()] == [1.0, 1.0]
    assert made.value == 2


EDGES = "graph_id long, src long, dst long, weight double"


def told(spark, rows):
    """Edges, and how many of them plans have made so far."""
    made = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, EDGES).mapInArrow(tell, EDGES), made


def path_rows(n):
    return [(0, a, b, 1.0) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))]


@pytest.mark.parametrize(("order_k", "reads"), [(1, 1), (2, 4)])
def test_rounds_of_an_independent_set_read_what_is_left(spark, order_k, reads):
    """On a path with rising ranks each round takes one node, so rounds that read all edges read them some 5 times and more."""
    from pebblegraph.operators import select

    e, made = told(spark, path_rows(12))
    nodes = spark.createDataFrame([(0, i, i) for i in range(12)], "graph_id long, node_id long, rank long")
    got = sorted(r.node_id for r in select.independent_set(nodes, e, nodes, order_k).collect())
    assert got == list(range(0, 12, order_k + 1))
    assert made.value <= reads * 22


def test_propagation_reads_edges_into_nodes_that_are_left(spark):
    from pebblegraph.operators import select

    e, made = told(spark, path_rows(9))
    nodes = spark.createDataFrame([(0, i, [1.0]) for i in range(9)], "graph_id long, node_id long, x array<double>")
    kept = spark.createDataFrame([(0, 0, 7)], "graph_id long, node_id long, cluster_id long")
    assert sorted((r.node_id, r.cluster_id) for r in select.assign_all(nodes, e, kept, 8).collect()) == [(i, 7) for i in range(9)]
    assert made.value <= 3 * 16


def test_one_direction_of_an_undirected_graph_is_matched(spark):
    from pebblegraph.operators import select

    rows = [(0, a, b, float((a * b) % 3 + 1)) for a in range(9) for b in range(9) if a != b and (a + b) % 4]
    e = spark.createDataFrame(rows, EDGES)
    nodes = spark.createDataFrame([(0, i) for i in range(9)], "graph_id long, node_id long")
    clusters = [sorted(map(tuple, select.graclus(nodes, e, spread=True, ties="hash", symmetric=s).collect())) for s in (True, False)]
    assert clusters[0] == clusters[1]
    with pytest.raises(ValueError, match="symmetric"):
        select.graclus(nodes, e, symmetric=True)


def test_loops_match_themselves_and_equal_ranks_are_refused(spark):
    from pebblegraph.operators import select

    e = spark.createDataFrame([(0, 1, 1, 0), (0, 1, 2, 1), (0, 2, 3, 2), (1, 1, 2, 0)], "graph_id long, src long, dst long, rank long")
    assert sorted(map(tuple, select.matching(e).collect())) == [(0, 1, 1, 0), (0, 2, 3, 2), (1, 1, 2, 0)]
    with pytest.raises(RuntimeError, match="unique"):
        select.matching(spark.createDataFrame([(0, 1, 2, 0), (0, 3, 4, 0)], e.schema)).collect()


def test_ranks_by_ranges_are_those_of_a_window(spark):
    from pebblegraph.plans.fixpoint import ranked

    df = spark.createDataFrame([(i % 3 if i % 7 else None, (i * 37) % 101) for i in range(400)], "g long, v long").withColumn("u", F.monotonically_increasing_id())
    a, b = (sorted(map(tuple, ranked(df, ["g"], [F.col("v").desc(), F.col("u")], "r", s).select("g", "v", "u", "r").collect()), key=repr) for s in (True, False))
    assert a == b


@pytest.mark.parametrize("name", ["lstm", "gru"])
def test_recurrent_readers_take_groups_over_batches(spark, name):
    """No task makes a table of each group; a group's state goes from one batch to the next."""
    from pebblegraph.operators import reduce

    rows = [(g if g else None, i, float((g * 7 + i * i) % 5), float(i % 3)) for g in range(9) for i in range(1 + 5 * (g % 3))]
    df = spark.createDataFrame(rows, "graph_id long, node_id long, x0 double, x1 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = reduce.aggregated(df, ["graph_id"], 2, name)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.graph_id: r.x for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 9
    for g in range(9):
        one = spark.createDataFrame([r for r in rows if r[0] == (g or None)], df.schema)
        assert got[g or None] == pytest.approx(reduce.aggregated(one, ["graph_id"], 2, name).first().x)


@pytest.mark.parametrize("spread", [True, False])
def test_a_pair_is_hashed_once_and_not_in_each_comparison(spark, spread):
    """A sort computes its expressions anew in each comparison, so it is given columns."""
    import hashlib

    from pebblegraph.operators import select

    rows = [(0, a, b, float((a * b) % 3 + 1)) for a in range(9) for b in range(9) if a != b and (a + b) % 4]
    out = select.ranked_edges(spark.createDataFrame(rows, EDGES), "weight", "hash", spread)
    assert out.columns == ["graph_id", "src", "dst", "weight", "rank"]
    tie = lambda r: hashlib.md5(f"{min(r[1:3])}:{max(r[1:3])}".encode()).hexdigest()
    want = sorted(rows, key=lambda r: (-r[3], tie(r), r[1]))
    assert [tuple(r)[:4] for r in sorted(out.collect(), key=lambda r: r["rank"])] == want
    sorts = [line for line in select.ranked_edges(spark.createDataFrame(rows, EDGES), "weight", "hash")._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line or "Window [" in line]
    assert sorts and not any("md5" in line for line in sorts)


def test_distances_take_graphs_over_batches(spark, monkeypatch):
    """No task makes a table of each graph; a graph goes from one batch to the next."""
    from pebblegraph.operators import kernels

    monkeypatch.setattr(kernels, "ROWS", 5)
    size = {0: 7, 1: 1, 2: 4, 3: 12, 9: 2}
    e = spark.createDataFrame([(g, *r[1:]) for g, n in size.items() for r in path_rows(n)] + [(4, 0, 1, 1.0)], EDGES)
    nodes = spark.createDataFrame([(g, i) for g, n in size.items() for i in range(n)] + [(3, 50), (4, 0), (4, 1)], "graph_id long, node_id long")
    leaders = nodes.where("node_id in (1, 3, 50) and graph_id <> 9")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = kernels.hops(nodes, e, leaders)
        assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(g, i, k, abs(i - k)) for g, n in size.items() for k in (1, 3) for i in range(n) if g != 9 and k < n]
    assert got == sorted([*want, (3, 50, 50, 0), (4, 1, 1, 0)])


@pytest.mark.parametrize(("scorer", "kind"), [("degree", "greedy"), ("canonical", None)])
def test_an_undirected_graph_is_read_once_and_kept_in_one_direction(spark, scorer, kind):
    from pebblegraph.operators import select

    r = np.random.default_rng(3)
    half = {(int(min(p)), int(max(p))) for p in r.integers(0, 40, (90, 2)) if p[0] != p[1]}
    rows = [(0, a, b, float((x * y) % 4 + 1)) for x, y in sorted(half) for a, b in ((x, y), (y, x))] + [(0, 3, 3, 5.0)]
    e, made = told(spark, rows)
    nodes = spark.createDataFrame([(0, i) for i in range(36)] + [(0, 77)], "graph_id long, node_id long")  # some ends are no nodes
    out = select.kmis(nodes, e, 1, scorer, kind, spread=True, symmetric=True)
    got = [sorted(map(tuple, df.collect())) for df in out]
    assert made.value == len(rows)
    assert [list(map(tuple, sorted(df.collect()))) for df in select.kmis(nodes, e, 1, scorer, kind, spread=True)] == got
    assert len(got[0]) == 37


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [1_000_000, 2])
def test_edges_pass_nodes_in_a_stream_where_these_are_not_broadcast(spark, monkeypatch, rows):
    """A merge join would sort the edges, of which a task holds a share that grows with them; nodes are hashed, over tasks in proportion."""
    from pebblegraph.operators import connect
    from pebblegraph.plans import fixpoint

    monkeypatch.setattr(fixpoint, "HASHED", rows)
    edges = spark.createDataFrame([(g, a, b, float(a + b)) for g in range(2) for a in range(8) for b in range(8) if a != b], EDGES)
    assign = spark.createDataFrame([(g, i, i // (2 + g), 1.0) for g in range(2) for i in range(7)], "graph_id long, node_id long, cluster_id long, weight double")
    want = sorted((g, a // (2 + g), b // (2 + g), float(a + b)) for g in range(2) for a in range(7) for b in range(7) if a != b)
    assert sorted(map(tuple, connect.relabelled(edges, assign).collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = connect.relabelled(edges, assign)
        assert "SortMergeJoin" not in (plan := physical(out)) and plan.count("ShuffledHashJoin") == 2
        assert ("REPARTITION_BY_NUM" in plan) == (rows == 2) and (rows > 2 or "8)" in plan)  # 14 nodes, 2 a task
        assert sorted(map(tuple, out.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_flagship_sorts_no_edges_and_reads_them_from_columns(spark, tables):
    from pebblegraph import queries

    want = sorted(map(tuple, queries.topk_pool_edges(spark, tables).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = queries.topk_pool_edges(spark, tables)
        assert "SortMergeJoin" not in (plan := physical(out)) and "Scan ExistingRDD" not in plan
        assert sorted(map(tuple, out.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_entropy_of_a_partition_makes_edges_once(spark, limit):
    from pebblegraph.operators import assignments

    rows = [(g, a, b, float((a * b) % 3 + 1)) for g in range(2) for a in range(9) for b in range(9) if (a + b) % 4 or a == b]
    e, made = told(spark, rows)
    assign = spark.createDataFrame([(g, i, i % 3, 1.0) for g in range(2) for i in range(8)], "graph_id long, node_id long, cluster_id long, weight double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = {r.graph_id: r.entropy for r in assignments.partition_entropy(e, assign).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert made.value == len(rows)
    there = [(a, b, w) for g, a, b, w in rows if g == 0 and a != b and max(a, b) < 8]
    vol, v, vc, cut = sum(w for *_, w in there), [0.0] * 8, [0.0] * 3, [0.0] * 3
    for a, b, w in there:
        v[a] += w
        vc[a % 3] += w
        cut[a % 3] += w * (a % 3 != b % 3)
    want = -(sum(v[i] * np.log2(v[i] / vc[i % 3]) for i in range(8)) + sum(cut[c] * np.log2(vc[c] / vol) for c in range(3))) / vol
    assert got == {0: pytest.approx(want), 1: pytest.approx(want)}
