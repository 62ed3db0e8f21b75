"""Assignments as tables, hierarchies, plans of negative sampling, and series, on graphs small enough to know the answer."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pebblegraph.graph import Graph
from pebblegraph.operators import assignments, connect, kernels, losses, ops, reduce, select
from pebblegraph.plans import poolers
from pebblegraph.plans.protocols import composed
from pebblegraph.sources import generators

ASSIGN = "graph_id long, node_id long, cluster_id long, weight double"


@pytest.fixture(scope="module")
def path(spark):
    return generators.path(spark, 6)


def bag(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_assignments_collate_and_separate(spark):
    a = spark.createDataFrame([(5, 0, 3, 1.0), (5, 1, 4, 1.0)], ASSIGN)
    b = spark.createDataFrame([(9, 0, 7, 2.0)], ASSIGN)
    both = assignments.collated_assigns([a, b])
    assert bag(both, "graph_id", "node_id", "cluster_id") == [(0, 0, 3), (0, 1, 4), (1, 0, 7)]
    assert bag(assignments.separated_assign(both, 0), "node_id", "cluster_id") == [(0, 0), (1, 1)]
    assert bag(assignments.block_clusters(assignments.rebased(both)), "graph_id", "cluster_id") == [(0, 0), (0, 1), (1, 2)]
    with pytest.raises(ValueError, match="columns"):
        assignments.collated_assigns([a, b.withColumn("more", F.lit(1))])
    with pytest.raises(ValueError, match="no assignments"):
        assignments.collated_assigns([])


def test_supernodes_without_gaps(spark):
    nodes = spark.createDataFrame([(0, i, [float(i)]) for i in (0, 1, 2, 3)], "graph_id long, node_id long, x array<double>")
    edges = spark.createDataFrame([(0, 0, 2, 1.0), (0, 2, 3, 2.0), (0, 1, 3, 3.0)], "graph_id long, src long, dst long, weight double")
    valid = spark.createDataFrame([(0, 0, True), (0, 1, False), (0, 2, True), (0, 3, True)], "graph_id long, cluster_id long, valid boolean")
    g = assignments.compacted(nodes, edges, valid)
    assert bag(g.nodes, "node_id", "x") == [(0, [0.0]), (1, [2.0]), (2, [3.0])]
    assert bag(g.edges, "src", "dst", "weight") == [(0, 1, 1.0), (1, 2, 2.0)]


def test_labels_of_kept_nodes(path):
    assert bag(assignments.one_hot_labels(path.nodes, path.nodes.where("node_id in (1, 4)")), "node_id", "label") == [(0, 0), (1, 1), (2, 0), (3, 0), (4, 2), (5, 0)]


def test_a_child_has_one_parent(spark):
    good = spark.createDataFrame([(0, 1, 7), (0, 1, 7), (0, 2, 7)], "graph_id long, child long, parent long")
    assert bag(assignments.parents(good), "child", "parent") == [(1, 7), (2, 7)]
    with pytest.raises(Exception, match="child 2 has two parents"):
        assignments.parents(good.union(spark.createDataFrame([(0, 2, 8)], good.schema))).collect()


def test_entropy_of_the_path_in_halves(spark):
    g = generators.path(spark, 4)
    halves = spark.createDataFrame([(0, i, i // 2, 1.0) for i in range(4)], ASSIGN)
    want = -(2 * (1 * math.log2(1 / 3) + 2 * math.log2(2 / 3)) + 2 * 1 * math.log2(3 / 6)) / 6
    assert assignments.partition_entropy(g.edges, halves).first()["entropy"] == pytest.approx(want)


def test_runs_of_equal_levels():
    f = lambda g: poolers.nopool(g)
    assert poolers.runs(["graclus", ("graclus", {}), {"name": "kmis", "order_k": 2}, f]) == [("graclus", {}, 2), ("kmis", {"order_k": 2}, 1), (f, {}, 1)]
    assert poolers.runs("sep") == [("sep", {}, 1)] and poolers.runs(("kmis", None)) == [("kmis", {}, 1)]


def test_levels_of_one_coding_tree(spark):
    g = generators.ring(spark, 12)
    levels = poolers.precoarsened(g, ["sep", "sep", lambda h: poolers.nopool(h)])
    tree = kernels.sep_levels(g.nodes, g.edges, 2)
    for k in (0, 1):
        assert bag(levels[k].assign, "node_id", "cluster_id") == bag(tree.where(F.col("level") == k), "child", "parent")
    sizes = [p.nodes.count() for p in levels]
    assert 12 > sizes[0] > sizes[1] >= 1 and sizes[2] == sizes[1]
    with pytest.raises(ValueError, match="cannot be precomputed"):
        poolers.precoarsened(g, ["sep", "topk"])


def test_hierarchies_collate_level_by_level(spark):
    h = [poolers.precoarsened(generators.ring(spark, n), ["graclus", "graclus"]) for n in (6, 8)]
    both = poolers.collated_levels(h)
    assert [p.nodes.count() for p in both] == [sum(x[k].nodes.count() for x in h) for k in (0, 1)]
    with pytest.raises(ValueError, match="levels"):
        poolers.collated_levels([h[0], h[1][:1]])


def test_a_pooler_keeps_its_first_result(path):
    calls = []
    p = poolers.Cached(lambda g: calls.append(1) or poolers.graclus(g))
    assert p(path) is p(path) and len(calls) == 1
    p.clear()
    p(path)
    assert len(calls) == 2


def test_steps_of_the_callers_own(path):
    pairs = lambda g: g.nodes.select("graph_id", "node_id", F.floor(F.col("node_id") / 2).alias("cluster_id"), F.lit(1.0).alias("weight"))
    g, a = composed(path, pairs, lambda n, s: reduce.reduced(n, s, lambda rows, keys, dims: rows.groupBy(*keys).agg(F.array(F.max("x0")).alias("x")), 1), connect.sparse_connect)
    assert bag(g.nodes, "node_id", "x") == [(0, [1.0]), (1, [3.0]), (2, [5.0])]
    assert bag(g.edges, "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    own = poolers.by_assignment(path, a)
    assert bag(own.edges, "src", "dst", "weight") == bag(g.edges, "src", "dst", "weight")


def test_negative_edges_by_density(spark):
    full, sparse = generators.full(spark, 5), generators.path(spark, 40)
    plan = {r["method"]: r for g in (full, sparse) for r in ops.sampling_plan(g.nodes, g.edges, 6).collect()}
    assert (plan["dense"]["share"], plan["dense"]["tries"]) == (0.0, 20)
    assert plan["sparse"]["share"] == pytest.approx(1 - 78 / 1560) and plan["sparse"]["tries"] == 6
    assert ops.chosen_negative_edges(full.nodes, full.edges, 6).count() == 0
    got = bag(ops.chosen_negative_edges(sparse.nodes, sparse.edges, 6), "src", "dst")
    assert 0 < len(got) <= 6 and all(abs(s - d) > 1 for s, d in got)


def test_series_of_the_gamma_function(spark):
    values = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 7.3, 50.0, 999.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", losses.lgamma(F.col("v")).alias("g"), losses.digamma(F.col("v")).alias("d")).collect()
    for r in rows:
        assert r["g"] == pytest.approx(math.lgamma(r["v"]), rel=1e-10, abs=1e-10)
        h = 1e-5 * r["v"]
        assert r["d"] == pytest.approx((math.lgamma(r["v"] + h) - math.lgamma(r["v"] - h)) / (2 * h), rel=1e-5, abs=1e-5)
    euler = next(r["d"] for r in rows if r["v"] == 1.0)
    assert euler == pytest.approx(-0.5772156649015329, abs=1e-10)


def test_attributes_follow_their_edges(path):
    e = path.edges.withColumn("attr", F.array(F.col("src").cast("double")))
    got = {(r["src"], r["dst"]): r["attr"] for r in ops.delta_gcn_attributes(path.nodes, e.union(e), 1).collect()}
    assert got[2, 3] == [4.0] and got[2, 2] == [0.0]


def test_kernels_refuse_what_a_task_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(kernels, "LARGEST", 3)
    with pytest.raises(ValueError, match="dense matrix of 3"):
        kernels._fits((0,), 4)
    kernels._fits((0,), 3)


def test_softmax_by_joins(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 1000.0), (1, 1000.0)], "graph_id long, v double")
    got = bag(ops.softmaxed(rows, F.col("v"), ["graph_id"], "p"), "graph_id", "p")
    assert got == [(0, pytest.approx(1 / (1 + math.e))), (0, pytest.approx(math.e / (1 + math.e))), (1, 0.5), (1, 0.5)]


def test_the_default_maxcut_network_is_two_propagations(path):
    m = ops.delta_gcn(path.nodes, path.edges, 2.0)
    eye = [[1.0]]
    got = bag(select.maxcut_scores(path.nodes, m, {"layers": [(eye, None)] * 2}), "node_id", "score")
    x = {i: float(i) for i in range(6)}
    deg = {0: 1, 5: 1} | {i: 2 for i in range(1, 5)}
    for _ in range(2):
        x = {i: math.tanh(-x[i] + sum(2 * x[j] / math.sqrt(deg[i] * deg[j]) for j in (i - 1, i + 1) if 0 <= j < 6)) for i in x}
    assert got == [(i, pytest.approx(math.tanh(x[i]))) for i in range(6)]


def test_graphs_are_tables_with_checked_columns(spark):
    with pytest.raises(ValueError, match="weight"):
        Graph(spark.createDataFrame([(0, 0, [0.0])], "graph_id long, node_id long, x array<double>"), spark.createDataFrame([(0, 0, 0)], "graph_id long, src long, dst long"))
