"""Values that can be worked out by hand on the path 0-1-2-3, and properties of the kernels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pebblegraph.graph import Graph, collated, separated
from pebblegraph.operators import connect, convolve, kernels, lift, losses, ops, reduce, select
from pebblegraph.plans import poolers
from pebblegraph.plans.fixpoint import ranked
from pebblegraph.sources import generators


@pytest.fixture(scope="module")
def path(spark):
    return Graph(*(d.cache() for d in (generators.path(spark, 4).nodes, generators.path(spark, 4).edges)))


@pytest.fixture(scope="module")
def halves(spark):
    """Hard clusters {0, 1} and {2, 3}, in long form."""
    return spark.createDataFrame([(0, i, k, float(i // 2 == k)) for i in range(4) for k in range(2)], "graph_id long, node_id long, cluster_id long, weight double").cache()


def hard(halves):
    return halves.where("weight > 0")


def table(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


def value(df):
    return df.first()["loss"]


@pytest.mark.parametrize(("name", "want"), [
    ("mincut", -2 / 3), ("motif_mincut", -0.5), ("orthogonality", 0), ("hosc_orthogonality", 0), ("cluster_size", 0), ("link_prediction", 6**0.5),
    ("entropy", 0), ("total_variation", 1 / 3), ("asymmetric_norm", 0), ("just_balance", -1), ("spectral", -1 / 6),
])
def test_objectives(path, halves, name, want):
    f = getattr(losses, name)
    over_edges = name in ("mincut", "motif_mincut", "link_prediction", "total_variation", "spectral")
    assert value(f(path.edges, halves) if over_edges else f(halves)) == pytest.approx(want, abs=1e-4)


def test_maxcut_of_an_alternating_split(spark, path):
    scores = spark.createDataFrame([(0, i, float((-1) ** i)) for i in range(4)], "graph_id long, node_id long, score double")
    assert value(losses.maxcut(path.edges, scores)) == pytest.approx(-1)


def test_connect_and_normalise(path, halves):
    assert table(connect.sparse_connect(path.edges, hard(halves), self_loops=True), "src", "dst", "weight") == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    assert table(connect.sparse_connect(path.edges, hard(halves), degree_norm=True), "src", "dst", "weight") == pytest.approx({(0, 1): 1, (1, 0): 1})
    for delta, own, ends, middle in ((2.0, -1, 2**0.5, 1), (0.85, 0.15, 0.601041, 0.425)):
        p = table(ops.delta_gcn(path.nodes, path.edges, delta), "src", "dst", "weight")
        assert [p[i, i] for i in range(4)] == pytest.approx([own] * 4)
        assert [p[0, 1], p[2, 3], p[1, 2]] == pytest.approx([ends, ends, middle], abs=1e-6)


def test_elimination(spark, path):
    kept = spark.createDataFrame([(0, 0, 0, 1.0), (0, 2, 1, 1.0)], "graph_id long, node_id long, cluster_id long, weight double")
    assert table(kernels.kron(path.nodes, path.edges, kept), "src", "dst", "weight") == pytest.approx({(0, 1): 0.5, (1, 0): 0.5})


def test_bipartition_by_the_top_eigenvector(path):
    kept = {r["node_id"] for r in kernels.ndp(path.nodes, path.edges).collect()}
    assert kept in ({0, 2}, {1, 3})


@pytest.mark.parametrize(("order", "k", "members", "clusters"), [("id", 1, {0, 2}, [0, 0, 1, 1]), ("reversed", 1, {1, 3}, [0, 0, 1, 1]), ("id", 2, {0, 3}, [0, 0, 0, 1])])
def test_independent_sets(path, order, k, members, clusters):
    score = (-F.col("node_id") if order == "id" else F.col("node_id")).cast("double")
    assign, mis = select.kmis(path.nodes, path.edges, k, path.nodes.select("graph_id", "node_id", score.alias("score")), None)
    assert {r["node_id"] for r in mis.collect()} == members
    got = table(assign, "node_id", "cluster_id")
    assert [got[i,] for i in range(4)] == clusters


def test_greedy_heuristic(path):
    got = table(select.heuristic(select.mis_scores(path.nodes, path.edges), path.edges), "node_id", "score")
    assert [got[i,] for i in range(4)] == pytest.approx([1 / 2, 2 / 3, 2 / 3, 1 / 2])


@pytest.mark.parametrize(("descending", "want"), [(False, {(0, 1), (2, 3)}), (True, {(3, 2), (1, 0)})])
def test_matching(path, descending, want):
    order = [F.col(c).desc() if descending else F.col(c) for c in ("src", "dst")]
    assert {(r["src"], r["dst"]) for r in select.matching(ranked(path.edges, ["graph_id"], order, "rank")).collect()} == want


def test_lift_by_the_inverse(path, halves):
    nodes = path.nodes.withColumn("x", F.array(F.col("node_id").cast("double")))
    pooled = reduce.reduced(nodes, hard(halves), "sum", 1)
    assert {r["node_id"]: r["x"][0] for r in pooled.collect()} == {0: 1, 1: 5}
    assert {r["node_id"]: r["x"][0] for r in lift.lifted(pooled, hard(halves), nodes, 1, "inverse").collect()} == {0: 0.5, 1: 0.5, 2: 2.5, 3: 2.5}
    s = np.random.default_rng(1).random((5, 3))
    soft = path.nodes.sparkSession.createDataFrame([(0, i, k, float(s[i, k])) for i in range(5) for k in range(3)], "graph_id long, node_id long, cluster_id long, weight double")
    got = table(kernels.pseudo_inverse(soft), "node_id", "cluster_id", "weight")
    assert np.allclose([[got[i, k] for k in range(3)] for i in range(5)], np.linalg.pinv(s).T)


def test_total_variation_convolution(spark, path):
    nodes = spark.createDataFrame([(0, i, [v]) for i, v in enumerate([0.0, 1.0, 3.0, 6.0])], "graph_id long, node_id long, x array<double>")
    got = {r["node_id"]: r["x"][0] for r in convolve.gtv_conv(nodes, path.edges, [[1.0]]).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([1, 1, 3, 5])


def test_topk_keeps_the_better_half(spark):
    scores = spark.createDataFrame([(0, i, float(i + 1)) for i in range(5)], "graph_id long, node_id long, score double")
    for spread in (False, True):
        assert table(select.topk(scores, 0.5, spread=spread), "node_id", "cluster_id") == {(4,): 0, (3,): 1, (2,): 2}


def test_collation_is_undone_by_separation(spark, path):
    both = collated([path, generators.ring(spark, 3)])
    assert both.nodes.select("graph_id").distinct().count() == 2
    for i, g in enumerate((path, generators.ring(spark, 3))):
        back = separated(both, i)
        for a, b in ((back.edges.drop("graph_id"), g.edges), (back.nodes.select("node_id"), g.nodes)):
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_gset_files(spark, tmp_path):
    (tmp_path / "g").write_text("3 2\n1 2 5\n2 3 -1\n")
    g = generators.gset(spark, f"file://{tmp_path}/g", dims=4)
    assert table(g.edges, "src", "dst", "weight") == {(0, 1): 5, (1, 0): 5, (1, 2): -1, (2, 1): -1}
    assert g.nodes.count() == 3


def test_names_and_checks(spark, path):
    assert callable(poolers.get_pooler("MinCut_u", k=3))
    with pytest.raises(ValueError, match="no pooler"):
        poolers.get_pooler("nothing")
    with pytest.raises(TypeError, match="needs k"):
        poolers.get_pooler("diff")
    with pytest.raises(ValueError, match="precomputed"):
        poolers.precoarsened(path, ["asap"])
    with pytest.raises(ValueError, match="no column"):
        Graph(path.nodes.drop("x"), path.edges)
    with pytest.raises(ValueError, match="integers"):
        Graph(path.nodes, path.edges.withColumn("src", F.lit("a")))


def test_every_pooler_runs_on_a_batch_with_a_lone_node(spark):
    g = collated([generators.path(spark, 6), generators.ring(spark, 5), generators.full(spark, 4)])
    g = Graph(g.nodes.withColumn("x", F.array(F.col("node_id").cast("double") / 10, F.lit(1.0))).unionByName(spark.createDataFrame([(3, 0, [0.5, 1.0])], "graph_id long, node_id long, x array<double>")), g.edges)
    for name in poolers.POOLERS:
        p = poolers.get_pooler(name, k=2)(g)
        assert p.nodes.select("graph_id").distinct().count() >= 3, name
        assert p.edges.where("src is null or dst is null").isEmpty(), name
