"""Queries of the part graph against brute force: no pair of parts that shares an order is left out."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

from pyspark.sql import functions as F

from pebblegraph import queries
from pebblegraph.graph import Graph, renumbered
from pebblegraph.operators import select
from pebblegraph.plans import poolers
from pebblegraph.plans.fixpoint import cut
from pebblegraph.sources import generators
from pebblegraph.sources import tables as source
from pebblegraph.queries import _DEGREE_SCORE, _DEGREE_SCORE_2, PARTS

ROUNDS = {"kmis_degree_k1": 12, "kmis_degree_k2": 9, "kmis_canonical": 14, "matching_by_weight": 16, "graclus_select": 16, "graclus_pool": 16, "ec_select": 8, "ec_pool": 12, "precoarsen_levels": 12}


@pytest.fixture(scope="module")
def part_graph(tables):
    """Nodes with their sizes, weighted edges, and a function that runs SQL on n and e of the whole graph."""
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    run = lambda sql: con.execute(f"WITH {PARTS} {sql}").fetchall()
    return dict(run("SELECT node_id, x0 FROM n")), {(s, d): w for s, d, w in run("SELECT src, dst, weight FROM e")}, run


def rows(spark, tables, name, *cols):
    return [tuple(r[c] for c in cols) for r in queries.queries()[name](spark, tables).collect()]


def greedy_matching(order):
    used, out = set(), []
    for s, d in order:
        if not {s, d} & used:
            used |= {s, d}
            out.append((s, d))
    return out


def clusters(nodes, matched):
    label = {n: n for n in nodes} | {d: s for s, d in matched}
    ids = {v: i for i, v in enumerate(sorted(set(label.values())))}
    return {n: ids[v] for n, v in label.items()}


def test_every_shared_order_is_an_edge(spark, tables, part_graph):
    assert Counter(rows(spark, tables, "graph_parts", "src", "dst", "weight")) == Counter((s, d, w) for (s, d), w in part_graph[1].items())
    assert 1.0 in part_graph[1].values()


def test_guessed_pairs_share_no_order(spark, tables, part_graph):
    got = rows(spark, tables, "negative_edges_sampled", "src", "dst")
    assert got and not [p for p in got if p in part_graph[1]]


def test_parts_with_a_kept_neighbour_get_a_neighbours_cluster(spark, tables, part_graph):
    nodes, edges, _ = part_graph
    kept = {n for n in nodes if n % 10 == 0}
    votes = defaultdict(Counter)
    for s, d in edges:
        if s in kept and d not in kept:
            votes[d][s] += 1
    got = dict(rows(spark, tables, "assign_all_nodes", "node_id", "cluster_id"))
    assert got.keys() == nodes.keys()
    for d, v in votes.items():
        assert got[d] == min(v, key=lambda c: (-v[c], c))


@pytest.mark.parametrize(("name", "k"), [("kmis_degree_k1", 1), ("kmis_degree_k2", 2), ("kmis_canonical", 1)])
def test_members_of_a_greedy_set(spark, tables, part_graph, name, k):
    nodes, edges, run = part_graph
    near = defaultdict(set)
    for s, d in edges:
        near[s].add(d)
    reach = {n: {n} for n in nodes}
    for _ in range(k):
        reach = {n: r | {d for s in r for d in near[s]} for n, r in reach.items()}
    if name == "kmis_canonical":
        h = {n: -n for n in nodes}
    else:
        found = run(f"SELECT node_id, s, h FROM ({_DEGREE_SCORE if k == 1 else _DEGREE_SCORE_2})")
        h, score = {n: v for n, _, v in found}, {n: v for n, v, _ in found}
    rank = {n: i for i, n in enumerate(sorted(nodes, key=lambda n: (-h[n], n)))}
    members, done = [], set()
    for n in sorted(nodes, key=rank.get):
        if n not in done:
            members.append(n)
            done |= reach[n]
    if name == "kmis_canonical":
        assert sorted(rows(spark, tables, name, "node_id", "rank")) == sorted((n, rank[n]) for n in members)
        return
    ids = {n: i for i, n in enumerate(sorted(members))}
    want = {n: (ids[min((m for m in members if m in reach[n]), key=rank.get)], score[n]) for n in nodes}
    assert {n: (c, w) for n, c, w in rows(spark, tables, name, "node_id", "cluster_id", "weight")} == want


def test_heavy_edge_matching(spark, tables, part_graph):
    nodes, edges, _ = part_graph
    tie = lambda p: (hashlib.md5(f"{min(p)}:{max(p)}".encode()).hexdigest(), p[0])
    matched = greedy_matching(sorted(edges, key=lambda p: (-edges[p], *tie(p))))
    assert sorted(rows(spark, tables, "matching_by_weight", "src", "dst")) == sorted(matched)
    own = clusters(nodes, matched)
    assert dict(rows(spark, tables, "graclus_select", "node_id", "cluster_id")) == own
    pooled = Counter()
    for (s, d), w in edges.items():
        if own[s] != own[d]:
            pooled[own[s], own[d]] += w
    assert {(s, d): w for s, d, w in rows(spark, tables, "graclus_pool", "src", "dst", "weight")} == pooled


def test_heavy_edge_matching_and_contraction_by_ends(spark, tables, part_graph):
    """The same graph with equal edges in the order of their ends, in which a matching takes many more rounds."""
    nodes, edges, _ = part_graph
    g = source.parts(spark, tables)
    matched = greedy_matching(sorted(edges, key=lambda p: (-edges[p], p)))
    assert {r["node_id"]: r["cluster_id"] for r in select.graclus(g.nodes, cut(g.edges), spread=True).collect()} == clusters(nodes, matched)
    matched = greedy_matching(sorted(edges, key=lambda p: (nodes[p[1]] - nodes[p[0]], p)))
    e = cut(g.edges)
    scored = select.edge_scores(g.nodes, e, [1 / 64, 0.0, -1 / 64, 0.0], "tanh")
    assert {r["node_id"]: r["cluster_id"] for r in select.edge_contraction(g.nodes, scored, spread=True).collect()} == clusters(nodes, matched)


def test_all_graphs_of_a_table_are_collated(spark, tables):
    nodes = spark.createDataFrame([(g, i, [0.0]) for g in (40, -3, 7) for i in range(3)] + [(9, 0, [1.0])], "graph_id long, node_id long, x array<double>")
    edges = spark.createDataFrame([(g, 0, 1 + g % 2, float(g)) for g in (40, -3, 7)], "graph_id long, src long, dst long, weight double")
    got = renumbered(Graph(nodes, edges))
    assert sorted(map(tuple, got.edges.select("graph_id", "src", "dst", "weight").collect())) == [(0, 0, 2, -3.0), (1, 0, 2, 7.0), (3, 0, 1, 40.0)]
    assert Counter(r["graph_id"] for r in got.nodes.collect()) == {0: 3, 1: 3, 2: 1, 3: 3}
    users = duckdb.execute(f"SELECT count(DISTINCT user_id) FROM '{tables}/events.parquet'").fetchone()[0]
    assert {g for g, in rows(spark, tables, "collated_graphs", "graph_id")} == set(range(users))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ROUNDS))
def test_the_last_round_of_the_sql_leaves_nothing(tables, name, sf):
    con = duckdb.connect()
    for t in ("lineitem", "part", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables.replace('sf0.001', sf)}/{t}.parquet'")
    steps, rounds = queries.oracle_sql()[name], ROUNDS[name]
    assert f"l{rounds} AS" in steps and f"l{rounds + 1} AS" not in steps
    left = steps[: steps.index(", z AS MATERIALIZED (")]  # of precoarsen_levels, the matching
    assert con.execute(f"{left} SELECT count(*) FROM l{rounds}").fetchone() == (0,)
    assert con.execute(f"{left} SELECT count(*) FROM l0").fetchone()[0] > 0


def test_generated_graphs_are_connected_or_refused(spark, tables):
    with pytest.raises(Exception, match="no connected two-block graph in 3 attempts"):
        generators.csbm(spark, 2, 20, 0.2, 0.1, attempts=3)[0].edges.collect()
    assert queries.queries()["generator_csbm"](spark, tables).select("graph_id").distinct().count() == 1024


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_last_round_of_the_second_level_leaves_nothing(tables, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tables.replace('sf0.001', sf)}/conversations.parquet'")
    steps = queries.oracle_sql()["precoarsen_levels"]
    left = steps[: steps.index(", yz AS MATERIALIZED (")]
    assert con.execute(f"{left} SELECT (SELECT count(*) FROM yl0) > 0, (SELECT count(*) FROM yl10)").fetchone() == (True, 0)


def window_keys(df) -> list[str]:
    """What each window of the plan is partitioned by, in its text."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Window [" in line or "windowspecdefinition" in line]


def test_no_window_holds_a_graph_where_ranks_are_spread(spark, tables):
    g = source.suppliers(spark, tables)
    g = Graph(g.nodes, cut(g.edges))
    plans = [
        select.graclus(g.nodes, g.edges, spread=True),
        select.from_labels(g.nodes.select("graph_id", "node_id", F.col("node_id").alias("label")), spread=True),
        select.topk(g.nodes.select("graph_id", "node_id", F.col("x")[0].alias("score")), None, 0.0001, spread=True),
        select.lapool_leaders(g.nodes, g.edges, 2),
    ]
    for df in plans:
        for line in window_keys(df):
            assert "_part" in line or "_shift" in line, line


def test_poolers_with_spread_ranks_give_the_same(spark, tables):
    g = source.conversations(spark, tables)
    for name, options in [("topk", {}), ("topk", {"ratio": None, "min_score": 0.2}), ("sag", {"act": "identity"}), ("pan", {}), ("asap", {"att": [0.5] * 4}), ("maxcut", {"layers": 0}), ("kmis", {}), ("graclus", {}), ("ec", {})]:
        a, b = (sorted(map(tuple, poolers.get_pooler(name, spread=s, **options)(g).assign.select("graph_id", "node_id", "cluster_id").collect())) for s in (False, True))
        assert a == b, name
