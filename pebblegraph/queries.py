"""One query for each operator, and the same in DuckDB's SQL where SQL can say it.

All SQL starts from the same two tables: n (graph_id, node_id, x0, x1) and e (graph_id, src, dst, weight) of one of the
table graphs. Sums of fractions are rounded to 6 places on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import hashed_weights, segment_softmax
from .graph import Graph
from .operators import assignments, connect, convolve, kernels, losses, ops, reduce, select
from .operators.lift import eigen_lifted, lifted
from .plans import poolers
from .plans.fixpoint import cut, scratch, stored
from .sources import generators, tables

QUERY = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QUERY] = {}
_SQL: dict[str, str] = {}

# --- the table graphs in SQL -----------------------------------------------------------------------------------------

_CO = "SELECT CAST(0 AS BIGINT) AS graph_id, a.k AS src, b.k AS dst, CAST(count(*) AS DOUBLE) AS weight FROM p a JOIN p b ON a.o = b.o AND a.k <> b.k GROUP BY a.k, b.k"
SUPPLIERS = f"""p AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS k FROM lineitem), e AS ({_CO}),
n AS (SELECT CAST(0 AS BIGINT) AS graph_id, s_suppkey AS node_id, CAST(s_nationkey AS DOUBLE) AS x0, CAST(floor(s_acctbal) AS DOUBLE) AS x1 FROM supplier)"""
PARTS = f"""p AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS k FROM lineitem), e AS MATERIALIZED ({_CO}),
n AS (SELECT CAST(0 AS BIGINT) AS graph_id, p_partkey AS node_id, CAST(p_size AS DOUBLE) AS x0, CAST(floor(p_retailprice) AS DOUBLE) AS x1 FROM part)"""
USERS = """t AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS t FROM (SELECT DISTINCT event_type FROM events)),
v AS (SELECT user_id, ts, event_id, t.t FROM events JOIN t USING (event_type)),
n AS (SELECT user_id AS graph_id, t AS node_id, CAST(count(*) AS DOUBLE) AS x0, CAST(sum(event_id % 2) AS DOUBLE) AS x1 FROM v GROUP BY user_id, t),
l AS (SELECT user_id, lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, t AS dst FROM v),
e AS (SELECT user_id AS graph_id, src, dst, CAST(count(*) AS DOUBLE) AS weight FROM l WHERE src IS NOT NULL GROUP BY user_id, src, dst)"""
CHATS = """n AS (SELECT conv_id AS graph_id, turn AS node_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS x0, CAST(CASE WHEN role = 'user' THEN 1 ELSE 0 END AS DOUBLE) AS x1 FROM conversations),
l AS (SELECT graph_id, lag(node_id) OVER (PARTITION BY graph_id ORDER BY node_id) AS src, node_id AS dst FROM n),
e AS (SELECT graph_id, src, dst, CAST(1 AS DOUBLE) AS weight FROM l WHERE src IS NOT NULL UNION ALL SELECT graph_id, dst, src, CAST(1 AS DOUBLE) FROM l WHERE src IS NOT NULL)"""
#: Hard clusters by id, and soft memberships by a small literal network.
HARD = "s AS (SELECT graph_id, node_id, node_id % 7 AS cluster_id, CAST(1 + node_id % 3 AS DOUBLE) AS weight FROM n)"
LAYERS = [([[0.02, -0.01, 0.03], [-0.04, 0.05, 0.01]], [0.1, 0.0, -0.1])]
SOFT = """lg AS (SELECT graph_id, node_id, x0 * 0.02 - x1 * 0.04 + 0.1 AS a, x1 * 0.05 - x0 * 0.01 AS b, x0 * 0.03 + x1 * 0.01 - 0.1 AS c FROM n),
ex AS (SELECT graph_id, node_id, exp(a - greatest(a, b, c)) AS a, exp(b - greatest(a, b, c)) AS b, exp(c - greatest(a, b, c)) AS c FROM lg),
s AS (SELECT graph_id, node_id, CAST(0 AS BIGINT) AS cluster_id, a / (a + b + c) AS weight FROM ex UNION ALL SELECT graph_id, node_id, 1, b / (a + b + c) FROM ex UNION ALL SELECT graph_id, node_id, 2, c / (a + b + c) FROM ex),
gk AS (SELECT graph_id, CAST(count(DISTINCT node_id) AS DOUBLE) AS n, 3.0 AS k FROM s GROUP BY graph_id)"""


def hard(g: Graph) -> DataFrame:
    return g.nodes.select("graph_id", "node_id", (F.col("node_id") % 7).alias("cluster_id"), (1 + F.col("node_id") % 3).cast("double").alias("weight"))


def soft(g: Graph) -> DataFrame:
    return select.mlp_select(g.nodes, LAYERS)


def flat(nodes: DataFrame, dims: int = 2, digits: int | None = None) -> DataFrame:
    """x as columns x0, x1, ..."""
    cell = lambda i: F.col("x")[i] if digits is None else F.round(F.col("x")[i], digits)
    return nodes.select("graph_id", "node_id", *(cell(i).alias(f"x{i}") for i in range(dims)))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def query(base: str | None = None, sql: str | None = None, steps: str = ""):
    """Register a query; sql follows WITH base, steps."""

    def add(f: QUERY) -> QUERY:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"WITH {base}{', ' + steps if steps else ''} {sql}" if base else sql
        return f

    return add


def queries() -> dict[str, QUERY]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- sources and plain graph steps -----------------------------------------------------------------------------------


@query(SUPPLIERS, "SELECT b.graph_id, b.src, b.dst, b.weight FROM (SELECT e.graph_id, a.c AS src, z.c AS dst, e.weight FROM e JOIN k a ON a.node_id = e.src JOIN k z ON z.node_id = e.dst) b",
       "d AS (SELECT n.node_id, coalesce(sum(e.weight), 0) AS w FROM n LEFT JOIN e ON e.dst = n.node_id GROUP BY n.node_id), k AS (SELECT node_id, row_number() OVER (ORDER BY w DESC, node_id) - 1 AS c FROM d QUALIFY c < ceil(0.5 * (SELECT count(*) FROM n)))")
def topk_pool_edges(spark, d):
    """The flagship: the supplier graph, coarsened to the better half by weighted degree."""
    g = tables.suppliers(spark, d)
    e = stored(g.edges)
    a = select.topk(ops.degree(g.nodes, e).withColumnRenamed("degree", "score"), 0.5, spread=True)
    return connect.sparse_connect(e, stored(a), None)


@query(SUPPLIERS, "SELECT * FROM e")
def graph_suppliers(spark, d):
    return tables.suppliers(spark, d).edges


@query(PARTS, "SELECT * FROM e")
def graph_parts(spark, d):
    return tables.parts(spark, d).edges


@query(USERS, "SELECT * FROM e")
def graph_transitions(spark, d):
    return tables.transitions(spark, d).edges


@query(CHATS, "SELECT * FROM e")
def graph_conversations(spark, d):
    return tables.conversations(spark, d).edges


@query(None, "WITH c AS (SELECT l_orderkey AS g, CAST(count(*) AS BIGINT) AS k FROM lineitem GROUP BY 1) SELECT g AS graph_id, k * (k - 1) AS n_edges FROM c WHERE k > 1")
def graph_order_cliques(spark, d):
    return tables.order_cliques(spark, d).edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))


@query(None, "WITH v AS (SELECT label AS g, vec_id AS i, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT CAST(a.g AS BIGINT) AS graph_id, a.i AS src, b.i AS dst, round(list_dot_product(a.x, b.x), 6) AS weight FROM v a JOIN v b ON a.g = b.g AND a.i <> b.i) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY graph_id, src ORDER BY weight DESC, dst) <= 5")
def graph_nearest(spark, d):
    return tables.nearest(spark, d).edges


@query(USERS, "SELECT n.graph_id, n.node_id, CAST(count(e.src) AS DOUBLE) AS degree FROM n LEFT JOIN e ON e.graph_id = n.graph_id AND e.dst = n.node_id GROUP BY ALL")
def degree_in(spark, d):
    g = tables.transitions(spark, d)
    return ops.degree(g.nodes, g.edges, "dst", False)


@query(USERS, "SELECT n.graph_id, n.node_id, coalesce(sum(e.weight), 0) AS degree FROM n LEFT JOIN e ON e.graph_id = n.graph_id AND e.src = n.node_id GROUP BY ALL")
def degree_weighted(spark, d):
    g = tables.transitions(spark, d)
    return ops.degree(g.nodes, g.edges, "src")


@query(USERS, "SELECT * FROM e UNION ALL SELECT graph_id, node_id, node_id, 1.0 FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = n.graph_id AND src = node_id AND dst = node_id)")
def self_loops_remaining(spark, d):
    g = tables.transitions(spark, d)
    return ops.add_remaining_self_loops(g.nodes, g.edges)


for _op, _agg in {"sum": "sum(weight)", "mean": "avg(weight)", "min": "min(weight)", "max": "max(weight)", "mul": "product(weight)"}.items():

    def _coalesce(spark, d, op=_op):
        g = tables.transitions(spark, d)
        return rounded(connect.sparse_connect(g.edges, g.nodes.select("graph_id", "node_id", (F.col("node_id") % 2).alias("cluster_id"), F.lit(1.0).alias("weight")), op, self_loops=True), "weight")

    _coalesce.__name__ = f"coalesce_{_op}"
    query(USERS, f"SELECT graph_id, src % 2 AS src, dst % 2 AS dst, round({_agg}, 6) AS weight FROM e GROUP BY ALL")(_coalesce)


@query(USERS, "SELECT graph_id, greatest(src, dst) AS src, least(src, dst) AS dst, max(weight) AS weight FROM e GROUP BY ALL")
def undirected_max(spark, d):
    return ops.undirected(tables.transitions(spark, d).edges).where("src >= dst")


@query(SUPPLIERS, "SELECT e.* FROM e JOIN k a ON a.node_id = src JOIN k b ON b.node_id = dst", "k AS (SELECT node_id FROM n WHERE x0 < 12)")
def subgraph_induced(spark, d):
    g = tables.suppliers(spark, d)
    return ops.induced(g.edges, g.nodes.where(F.col("x")[0] < 12))


_DEG = "dg AS (SELECT graph_id, src AS v, sum(weight) AS w FROM {} WHERE src <> dst GROUP BY ALL)"


@query(CHATS, "SELECT e.graph_id, src, dst, round(weight * 2.0 / sqrt(a.w * b.w), 6) AS weight FROM e JOIN dg a ON a.graph_id = e.graph_id AND a.v = src JOIN dg b ON b.graph_id = e.graph_id AND b.v = dst WHERE src <> dst UNION ALL SELECT graph_id, node_id, node_id, -1.0 FROM n", _DEG.format("e"))
def delta_gcn(spark, d):
    g = tables.conversations(spark, d)
    return rounded(ops.delta_gcn(g.nodes, g.edges, 2.0), "weight")


@query(CHATS, "SELECT e.graph_id, src, dst, round(weight * 0.85 / sqrt(a.w * b.w), 6) AS weight FROM e JOIN dg a ON a.graph_id = e.graph_id AND a.v = src JOIN dg b ON b.graph_id = e.graph_id AND b.v = dst WHERE src <> dst UNION ALL SELECT graph_id, node_id, node_id, 0.15 FROM n", _DEG.format("e"))
def normalize_adj(spark, d):
    g = tables.conversations(spark, d)
    return rounded(ops.delta_gcn(g.nodes, g.edges, 0.85), "weight")


@query(USERS, "SELECT graph_id, sum(CASE WHEN src = dst THEN weight ELSE 0 END) AS trace FROM e GROUP BY graph_id")
def adjacency_trace(spark, d):
    return ops.trace(tables.transitions(spark, d).edges)


@query(USERS, "SELECT graph_id, src, dst, src * 5 + dst AS id, (src * 5 + dst) // 5 AS src_back, (src * 5 + dst) % 5 AS dst_back FROM e")
def edge_id_roundtrip(spark, d):
    e = tables.transitions(spark, d).edges.select("graph_id", "src", "dst", ops.edge_to_id(F.col("src"), F.col("dst"), 5).alias("id"))
    a, b = ops.id_to_edge(F.col("id"), 5)
    return e.select("*", a.alias("src_back"), b.alias("dst_back"))


@query(USERS, "SELECT graph_id, src, dst FROM (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, row_number() OVER (PARTITION BY a.graph_id ORDER BY a.node_id, b.node_id) AS r FROM n a JOIN n b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = a.graph_id AND src = a.node_id AND dst = b.node_id)) WHERE r <= 3")
def negative_edges_first_n(spark, d):
    g = tables.transitions(spark, d)
    return ops.negative_edges(g.nodes, g.edges, 3)


@query()
def negative_edges_sampled(spark, d):
    g = tables.parts(spark, d)
    return ops.sampled_negative_edges(g.nodes, g.edges, 3)


@query(None, "WITH b AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), f AS (SELECT c_custkey AS src, s_suppkey AS dst FROM customer, supplier WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.src = c_custkey AND b.dst = s_suppkey)) SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM f) WHERE r <= 2")
def bipartite_negative_edges(spark, d):
    b = tables.table(spark, d, "orders").join(tables.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return ops.bipartite_negative_edges(tables.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")), b, 2)


@query(USERS, "SELECT g.graph_id, k.k AS cluster_id, coalesce((SELECT sum(weight) FROM s WHERE s.graph_id = g.graph_id AND s.cluster_id = k.k), 0) > 0 AS valid FROM (SELECT DISTINCT graph_id FROM n) g, (SELECT unnest(range(0, 7)) AS k) k", HARD)
def out_mask(spark, d):
    return ops.out_mask(hard(tables.transitions(spark, d)), 7)


@query(USERS, "SELECT max(w) - min(w) <= 1e-5 AND abs(min(w)) > 1e-5 AS expressive FROM (SELECT sum(weight) AS w FROM s GROUP BY graph_id, node_id)", SOFT)
def is_expressive(spark, d):
    g = tables.transitions(spark, d)
    return ops.is_expressive(g.nodes, soft(g))


@query(CHATS, "SELECT graph_id, CAST((dense_rank() OVER (ORDER BY graph_id) - 1) // 32 AS BIGINT) AS batch_id FROM (SELECT DISTINCT graph_id FROM n)")
def loader_batches(spark, d):
    return generators.batches(tables.conversations(spark, d).nodes, 32)


@query(USERS, "SELECT k.c AS graph_id, src, dst, weight FROM e JOIN (SELECT graph_id, CAST(row_number() OVER (ORDER BY graph_id) - 1 AS BIGINT) AS c FROM (SELECT DISTINCT graph_id FROM n)) k USING (graph_id)")
def collated_graphs(spark, d):
    """The graphs of all users."""
    from .graph import renumbered

    return renumbered(tables.transitions(spark, d)).edges


@query(CHATS, "SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY x0, node_id) - 1 AS BIGINT) AS node_id, x0, x1 FROM n")
def sort_nodes(spark, d):
    g = tables.conversations(spark, d)
    return flat(convolve.sorted_nodes(g.nodes.withColumn("y", F.col("x")[0]), g.edges)[0])


@query(None, "SELECT CAST(0 AS BIGINT) AS graph_id, r * 7 + c AS src, r * 7 + (c + 1) % 7 AS dst FROM (SELECT unnest(range(0, 5)) AS r), (SELECT unnest(range(0, 7)) AS c) UNION ALL SELECT 0, r * 7 + (c + 1) % 7, r * 7 + c FROM (SELECT unnest(range(0, 5)) AS r), (SELECT unnest(range(0, 7)) AS c) UNION ALL SELECT 0, r * 7 + c, (r + 1) % 5 * 7 + c FROM (SELECT unnest(range(0, 5)) AS r), (SELECT unnest(range(0, 7)) AS c) UNION ALL SELECT 0, (r + 1) % 5 * 7 + c, r * 7 + c FROM (SELECT unnest(range(0, 5)) AS r), (SELECT unnest(range(0, 7)) AS c)")
def generator_torus(spark, d):
    return generators.grid(spark, 5, 7, True).edges.drop("weight")


@query(None, "SELECT CAST(0 AS BIGINT) AS graph_id, i AS src, (i + 1) % 11 AS dst FROM (SELECT unnest(range(0, 11)) AS i) UNION ALL SELECT 0, (i + 1) % 11, i FROM (SELECT unnest(range(0, 11)) AS i)")
def generator_ring(spark, d):
    return generators.ring(spark, 11).edges.drop("weight")


@query()
def generator_csbm(spark, d):
    return generators.csbm(spark)[0].edges


# --- select ----------------------------------------------------------------------------------------------------------


@query(USERS, "SELECT graph_id, node_id, r - 1 AS cluster_id, x0 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY x0 DESC, node_id) AS r, count(*) OVER (PARTITION BY graph_id) AS c FROM n) WHERE r <= ceil(0.5 * c)")
def topk_multigraph(spark, d):
    n = tables.transitions(spark, d).nodes
    return select.topk(n.select("graph_id", "node_id", F.col("x")[0].alias("score")), 0.5)


@query(SUPPLIERS, "SELECT graph_id, node_id, CAST(r - 1 AS BIGINT) AS cluster_id, round(v, 6) AS weight FROM (SELECT *, row_number() OVER (ORDER BY v DESC, node_id) AS r FROM (SELECT graph_id, node_id, (x0 * 3.0 + x1 * 4.0) / 5.0 AS v FROM n)) WHERE r <= 10")
def topk_linear(spark, d):
    n = tables.suppliers(spark, d).nodes
    return rounded(select.topk(select.linear_score(n, [3.0, 4.0], None), 10, spread=True), "weight")


@query(CHATS, "SELECT graph_id, node_id, r - 1 AS cluster_id, round(p, 6) AS weight FROM (SELECT graph_id, node_id, p, row_number() OVER (PARTITION BY graph_id ORDER BY p DESC, node_id) AS r FROM (SELECT *, ex / sum(ex) OVER (PARTITION BY graph_id) AS p FROM (SELECT *, exp(x0 / 100 - max(x0 / 100) OVER (PARTITION BY graph_id)) AS ex FROM n))) WHERE p > 0.2 OR r = 1")
def min_score_softmax(spark, d):
    n = tables.conversations(spark, d).nodes
    return rounded(select.topk(n.select("graph_id", "node_id", (F.col("x")[0] / 100).alias("score")), None, 0.2), "weight")


@query(SUPPLIERS, "SELECT graph_id, node_id, node_id AS cluster_id, CAST(1 AS DOUBLE) AS weight FROM n")
def identity_select(spark, d):
    return select.identity(tables.suppliers(spark, d).nodes)


@query(SUPPLIERS, "SELECT graph_id, node_id, CAST(dense_rank() OVER (PARTITION BY graph_id ORDER BY x0) - 1 AS BIGINT) AS cluster_id, CAST(1 AS DOUBLE) AS weight FROM n")
def cluster_to_s(spark, d):
    n = tables.suppliers(spark, d).nodes
    return select.from_labels(n.select("graph_id", "node_id", F.col("x")[0].alias("label")))


def _mis_sql(k: int, rounds: int, score: str) -> str:
    """CTEs w{i}: the members of each round, and r (ranks), z (members), q (least rank within k steps of each node)."""
    out = [f"sc AS MATERIALIZED ({score})", "r AS MATERIALIZED (SELECT node_id, CAST(row_number() OVER (ORDER BY h DESC, node_id) - 1 AS BIGINT) AS rk FROM sc)", "l0 AS (SELECT * FROM r)"]

    def least(name: str, start: str) -> list[str]:
        steps = [f"{name}0 AS (SELECT n.node_id, v.rk AS m FROM n LEFT JOIN {start} v USING (node_id))"]
        for j in range(k):
            steps.append(f"{name}{j + 1} AS MATERIALIZED (SELECT a.node_id, least(any_value(a.m), min(b.m)) AS m FROM {name}{j} a LEFT JOIN e ON e.dst = a.node_id LEFT JOIN {name}{j} b ON b.node_id = e.src GROUP BY a.node_id)")
        return steps

    for i in range(rounds):
        out += least(f"m{i}_", f"l{i}")
        out.append(f"w{i} AS MATERIALIZED (SELECT l.node_id, l.rk FROM l{i} l JOIN m{i}_{k} m USING (node_id) WHERE l.rk = m.m)")
        cover = f"SELECT node_id FROM w{i}"
        for j in range(k):
            out.append(f"c{i}_{j} AS MATERIALIZED ({cover} UNION SELECT dst FROM e JOIN ({cover}) c ON c.node_id = e.src)")
            cover = f"SELECT node_id FROM c{i}_{j}"
        out.append(f"l{i + 1} AS MATERIALIZED (SELECT * FROM l{i} WHERE node_id NOT IN ({cover}))")
    out.append("z AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(rounds)) + ")")
    return ", ".join(out + least("q", "z"))


_DEGREE_SCORE = "SELECT n.node_id, coalesce(sum(e.weight), 0) AS s, coalesce(sum(e.weight), 0) / (1 + count(e.src)) AS h FROM n LEFT JOIN e ON e.dst = n.node_id GROUP BY n.node_id"
_DEGREE_SCORE_2 = "WITH k1 AS (SELECT n.node_id, coalesce(sum(e.weight), 0) AS s, 1 + count(e.src) AS k FROM n LEFT JOIN e ON e.dst = n.node_id GROUP BY n.node_id) SELECT a.node_id, a.s, a.s / (a.k + coalesce(sum(b.k), 0)) AS h FROM k1 a LEFT JOIN e ON e.dst = a.node_id LEFT JOIN k1 b ON b.node_id = e.src GROUP BY a.node_id, a.s, a.k"
_KMIS_OUT = "SELECT CAST(0 AS BIGINT) AS graph_id, q.node_id, CAST(i.c AS BIGINT) AS cluster_id, CAST(sc.s AS DOUBLE) AS weight FROM q{k} q JOIN (SELECT rk, row_number() OVER (ORDER BY node_id) - 1 AS c FROM z) i ON i.rk = q.m JOIN sc ON sc.node_id = q.node_id"


@query(PARTS, _KMIS_OUT.format(k=1), _mis_sql(1, 12, _DEGREE_SCORE))
def kmis_degree_k1(spark, d):
    g = tables.parts(spark, d)
    return select.kmis(g.nodes, g.edges, 1, spread=True, symmetric=True)[0]


@query(PARTS, _KMIS_OUT.format(k=2), _mis_sql(2, 9, _DEGREE_SCORE_2))
def kmis_degree_k2(spark, d):
    g = tables.parts(spark, d)
    return select.kmis(g.nodes, stored(g.edges), 2, spread=True)[0]


@query(PARTS, "SELECT CAST(0 AS BIGINT) AS graph_id, node_id, rk AS rank FROM z", _mis_sql(1, 14, "SELECT node_id, CAST(-node_id AS DOUBLE) AS s, CAST(-node_id AS DOUBLE) AS h FROM n"))
def kmis_canonical(spark, d):
    g = tables.parts(spark, d)
    return select.kmis(g.nodes, g.edges, 1, "canonical", None, spread=True, symmetric=True)[1]


#: Equal edges by a hash of the pair, see ranked_edges().
_TIES = "md5(least(src, dst) || ':' || greatest(src, dst)), src"


def _matching_sql(rounds: int, order: str, source: str = "e WHERE src <> dst") -> str:
    out = [f"l0 AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY {order}) - 1 AS rk FROM {source})"]
    for i in range(rounds):
        out.append(f"m{i} AS MATERIALIZED (SELECT v, min(rk) AS m FROM (SELECT src AS v, rk FROM l{i} UNION ALL SELECT dst, rk FROM l{i}) GROUP BY v)")
        out.append(f"w{i} AS MATERIALIZED (SELECT l.* FROM l{i} l JOIN m{i} a ON a.v = src JOIN m{i} b ON b.v = dst WHERE rk = a.m AND rk = b.m)")
        out.append(f"l{i + 1} AS MATERIALIZED (SELECT * FROM l{i} WHERE src NOT IN (SELECT src FROM w{i} UNION SELECT dst FROM w{i}) AND dst NOT IN (SELECT src FROM w{i} UNION SELECT dst FROM w{i}))")
    out.append("z AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(rounds)) + ")")
    out.append("cl AS MATERIALIZED (SELECT node_id, CAST(dense_rank() OVER (ORDER BY coalesce(z.src, node_id)) - 1 AS BIGINT) AS c FROM n LEFT JOIN z ON z.dst = n.node_id)")
    return ", ".join(out)


@query(PARTS, "SELECT CAST(0 AS BIGINT) AS graph_id, src, dst FROM z", _matching_sql(16, "weight DESC, " + _TIES))
def matching_by_weight(spark, d):
    e = tables.parts(spark, d).edges
    e = e.where("src < dst")  # its reverse has the same weight, comes right after it and joins nothing
    return select.matching(select.ranked_edges(e, "weight", "hash", True)).drop("rank")


@query(PARTS, "SELECT CAST(0 AS BIGINT) AS graph_id, node_id, c AS cluster_id, CAST(1 AS DOUBLE) AS weight FROM cl", _matching_sql(16, "weight DESC, " + _TIES))
def graclus_select(spark, d):
    g = tables.parts(spark, d)
    return select.graclus(g.nodes, g.edges, spread=True, ties="hash", symmetric=True)


@query(PARTS, "SELECT CAST(0 AS BIGINT) AS graph_id, a.c AS src, b.c AS dst, sum(weight) AS weight FROM e JOIN cl a ON a.node_id = src JOIN cl b ON b.node_id = dst WHERE a.c <> b.c GROUP BY ALL", _matching_sql(16, "weight DESC, " + _TIES))
def graclus_pool(spark, d):
    g = tables.parts(spark, d)
    return poolers.graclus(Graph(g.nodes, stored(g.edges)), spread=True, ties="hash", symmetric=True).edges


#: Nodes of many graphs under one id, node ids being below 1,000.
_KEYED = "ke AS (SELECT graph_id * 1000 + src AS src, graph_id * 1000 + dst AS dst, {} AS s FROM {})"
_MATCHED = "lb AS (SELECT n.graph_id, n.node_id, coalesce(z.src, n.graph_id * 1000 + n.node_id) AS label FROM n LEFT JOIN z ON z.dst = n.graph_id * 1000 + n.node_id), cm AS MATERIALIZED (SELECT graph_id, node_id, CAST(dense_rank() OVER (PARTITION BY graph_id ORDER BY label) - 1 AS BIGINT) AS c FROM lb), p0 AS MATERIALIZED (SELECT e.graph_id, a.c AS src, b.c AS dst, sum(weight) AS weight FROM e JOIN cm a ON a.graph_id = e.graph_id AND a.node_id = src JOIN cm b ON b.graph_id = e.graph_id AND b.node_id = dst WHERE a.c <> b.c GROUP BY ALL)"


@query(USERS, "SELECT graph_id, node_id, c AS cluster_id FROM cm", "sc AS (SELECT e.graph_id, src, dst, tanh((a.x0 - b.x0) / 64.0) + 0.5 AS s FROM e JOIN n a ON a.graph_id = e.graph_id AND a.node_id = src JOIN n b ON b.graph_id = e.graph_id AND b.node_id = dst WHERE src <> dst), " + _KEYED.format("s", "sc") + ", " + _matching_sql(8, "s DESC, src, dst", "ke") + ", " + _MATCHED)
def ec_select(spark, d):
    g = tables.transitions(spark, d)
    e = cut(ops.remove_self_loops(g.edges))
    s = select.edge_scores(g.nodes, e, [1 / 64, 0.0, -1 / 64, 0.0], "tanh")
    return select.edge_contraction(g.nodes, s).drop("weight")


_VOTES = "SELECT dst AS node_id, cluster_id FROM (SELECT e.dst, k.cluster_id, row_number() OVER (PARTITION BY e.dst ORDER BY count(*) DESC, k.cluster_id) AS r FROM e JOIN {0} k ON k.node_id = e.src WHERE e.dst NOT IN (SELECT node_id FROM {0}) GROUP BY e.dst, k.cluster_id) WHERE r = 1"


@query(PARTS, "SELECT CAST(0 AS BIGINT) AS graph_id, * FROM (" + _VOTES.format("k0") + ")", "k0 AS (SELECT node_id, node_id AS cluster_id FROM n WHERE node_id % 10 = 0)")
def propagate_one_round(spark, d):
    g = tables.parts(spark, d)
    return select.propagate_once(g.nodes.where("node_id % 10 = 0").select("graph_id", "node_id", F.col("node_id").alias("cluster_id")), g.edges)


@query(PARTS, "SELECT CAST(0 AS BIGINT) AS graph_id, node_id, cluster_id FROM k5", "k0 AS (SELECT node_id, node_id AS cluster_id FROM n WHERE node_id % 10 = 0), " + ", ".join(f"k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} UNION ALL {_VOTES.format(f'k{i}')})" for i in range(5)))
def assign_reachable_nodes(spark, d):
    """What five rounds reach; assign_all() adds hashed choices for the rest."""
    g = tables.parts(spark, d)
    kept = g.nodes.where("node_id % 10 = 0").select("graph_id", "node_id", F.col("node_id").alias("cluster_id"))
    return select.propagate(stored(g.edges), kept, 5)


@query(PARTS, "SELECT CAST(0 AS BIGINT) AS graph_id, node_id, cluster_id, CAST(1 AS DOUBLE) AS weight FROM k5", "k0 AS (SELECT node_id, node_id AS cluster_id FROM n WHERE node_id % 10 = 0), " + ", ".join(f"k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} UNION ALL {_VOTES.format(f'k{i}')})" for i in range(5)))
def assign_all_nodes(spark, d):
    """Five rounds reach every node of these graphs, so that none is left for a hashed choice."""
    g = tables.parts(spark, d)
    kept = g.nodes.where("node_id % 10 = 0").select("graph_id", "node_id", F.col("node_id").alias("cluster_id"))
    return select.assign_all(g.nodes, stored(g.edges), kept, spread=True)


@query(USERS, "SELECT graph_id, node_id, cluster_id, round(weight, 6) AS weight FROM s", SOFT)
def mlp_select(spark, d):
    return rounded(soft(tables.transitions(spark, d)), "weight")


_SP = "greatest(0.001, least(1000, greatest({0}, 0) + ln(1 + exp(-abs({0})))))"


@query(USERS, "SELECT graph_id, node_id, CAST(0 AS BIGINT) AS cluster_id, round(v0, 6) AS weight FROM v2 UNION ALL SELECT graph_id, node_id, 1, round((1 - v0) * v1, 6) FROM v2 UNION ALL SELECT graph_id, node_id, 2, round((1 - v0) * (1 - v1), 6) FROM v2",
       f"v1 AS (SELECT graph_id, node_id, {_SP.format('(x0 * 0.02 + 0.1)')} AS a0, {_SP.format('(x1 * 0.03)')} AS a1, {_SP.format('(x0 * 0.01)')} AS b0, {_SP.format('(x1 * -0.02)')} AS b1 FROM n), v2 AS (SELECT graph_id, node_id, a0 / (a0 + b0) AS v0, a1 / (a1 + b1) AS v1 FROM v1)")
def stick_breaking(spark, d):
    return rounded(select.dp_select(tables.transitions(spark, d).nodes, [([[0.02, 0.0, 0.01, 0.0], [0.0, 0.03, 0.0, -0.02]], [0.1, 0.0, 0.0, 0.0])]), "weight")


_LEAD = """ax AS (SELECT e.graph_id, e.src AS node_id, sum(weight) AS d, sum(weight * n.x0) AS a0, sum(weight * n.x1) AS a1 FROM e JOIN n ON n.graph_id = e.graph_id AND n.node_id = e.dst WHERE e.src <> e.dst GROUP BY ALL),
lv AS (SELECT n.graph_id, n.node_id, x0, x1, round(sqrt(coalesce(power(d * x0 - a0, 2), 0) + coalesce(power(d * x1 - a1, 2), 0)), 9) AS v FROM n LEFT JOIN ax USING (graph_id, node_id)),
lm AS (SELECT e.graph_id, e.src AS node_id, max(v) AS m FROM e JOIN lv ON lv.graph_id = e.graph_id AND lv.node_id = e.dst WHERE e.src <> e.dst GROUP BY ALL),
ld AS (SELECT lv.*, v >= coalesce(m, -1) AS lead0 FROM lv LEFT JOIN lm USING (graph_id, node_id)),
lead AS (SELECT graph_id, node_id, x0, x1, v, lead0 OR NOT bool_or(lead0) OVER (PARTITION BY graph_id) AS leader FROM ld)"""


@query(CHATS, "SELECT graph_id, node_id, round(v, 6) AS v, leader FROM lead", _LEAD)
def lapool_leaders(spark, d):
    g = tables.conversations(spark, d)
    return rounded(select.lapool_leaders(g.nodes, g.edges, 2), "v")


@query(CHATS, "SELECT graph_id, node_id, cluster_id, round(CASE WHEN leader THEN CASE WHEN node_id = l THEN 1.0 ELSE 0.0 END ELSE ex / sum(ex) OVER (PARTITION BY graph_id, node_id) END, 6) AS weight FROM (SELECT a.graph_id, a.node_id, a.leader, b.l, b.cluster_id, exp((a.x0 * b.x0 + a.x1 * b.x1) / greatest(sqrt(a.x0 * a.x0 + a.x1 * a.x1) * sqrt(b.x0 * b.x0 + b.x1 * b.x1), 1e-8)) AS ex FROM lead a JOIN li b USING (graph_id))",
       _LEAD + ", li AS (SELECT graph_id, node_id AS l, x0, x1, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS cluster_id FROM lead WHERE leader)")
def lapool_assign(spark, d):
    g = tables.conversations(spark, d)
    return rounded(select.lapool(g.nodes, g.edges, 2), "weight")


# --- reduce and readout ----------------------------------------------------------------------------------------------

_REDUCE_SQL = {"sum": "sum({})", "mean": "avg({})", "max": "max({})", "min": "min({})", "var": "var_pop({})", "std": "stddev_pop({})", "median": "quantile_disc({}, 0.5)", "quantile": "quantile_cont({}, 0.5)", "variance_preserving": "sum({}) / sqrt(count(*))", "power_mean": "power(avg(power({}, 2.0)), 0.5)", "mul": "product({})"}
for _op, _agg in _REDUCE_SQL.items():
    _base, _graph = (CHATS, tables.conversations) if _op != "mul" else (USERS, tables.transitions)

    def _reduce(spark, d, op=_op, graph=_graph):
        g = graph(spark, d)
        nodes = g.nodes if op != "mul" else g.nodes.withColumn("x", F.transform("x", lambda v: 1 + v % 3))
        return flat(reduce.reduced(nodes, hard(g).withColumn("cluster_id", F.col("node_id") % 3), op, 2, **({"p": 2.0} if op == "power_mean" else {})), 2, 6)

    _reduce.__name__ = f"reduce_{_op}"
    _xs = ["n.x0", "n.x1"] if _op != "mul" else ["(1 + n.x0 % 3)", "(1 + n.x1 % 3)"]
    query(_base, f"SELECT graph_id, node_id % 3 AS node_id, round({_agg.format(f'(s.weight * {_xs[0]})')}, 6) AS x0, round({_agg.format(f'(s.weight * {_xs[1]})')}, 6) AS x1 FROM n JOIN s USING (graph_id, node_id) GROUP BY graph_id, node_id % 3", HARD)(_reduce)


@query(CHATS, "SELECT graph_id, c AS node_id, round(sum(v0 * e0) / sum(e0), 6) AS x0, round(sum(v1 * e1) / sum(e1), 6) AS x1 FROM (SELECT *, exp(0.01 * v0 - max(0.01 * v0) OVER (PARTITION BY graph_id, c)) AS e0, exp(0.01 * v1 - max(0.01 * v1) OVER (PARTITION BY graph_id, c)) AS e1 FROM (SELECT graph_id, node_id % 3 AS c, s.weight * x0 AS v0, s.weight * x1 AS v1 FROM n JOIN s USING (graph_id, node_id))) GROUP BY ALL", HARD)
def aggr_softmax(spark, d):
    g = tables.conversations(spark, d)
    return flat(reduce.reduced(g.nodes, hard(g).withColumn("cluster_id", F.col("node_id") % 3), "softmax", 2, t=0.01), 2, 6)


@query(CHATS, "SELECT graph_id, max(CASE WHEN r = 1 THEN x0 END) AS x0, max(CASE WHEN r = 1 THEN x1 END) AS x1, coalesce(max(CASE WHEN r = 2 THEN x0 END), 0) AS x2, coalesce(max(CASE WHEN r = 2 THEN x1 END), 0) AS x3 FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY x1 DESC, node_id) AS r FROM n) GROUP BY graph_id")
def readout_sort(spark, d):
    x = reduce.readout(tables.conversations(spark, d).nodes, "sort", None, 2, k=2)
    return x.select("graph_id", *(F.col("x")[i].alias(f"x{i}") for i in range(4)))


@query(CHATS, "SELECT graph_id, round(avg(x0), 6) AS x0, round(avg(x0) * ln(count(*) + 1.0) / 1.5, 6) AS x1, round(avg(x0) * 1.5 / ln(count(*) + 1.0), 6) AS x2 FROM n GROUP BY graph_id")
def aggr_degree_scaler(spark, d):
    n = tables.conversations(spark, d).nodes
    x = reduce.readout(n, "degree_scaler", None, 1, ops=["mean"], delta=1.5)
    return x.select("graph_id", *(F.round(F.col("x")[i], 6).alias(f"x{i}") for i in range(3)))


for _op, _agg in {"sum": "sum({})", "mean": "avg({})", "max": "max({})"}.items():

    def _readout(spark, d, op=_op):
        return reduce.readout(tables.transitions(spark, d).nodes, op, None, 2).select("graph_id", *(F.round(F.col("x")[i], 6).alias(f"x{i}") for i in range(2)))

    _readout.__name__ = f"readout_{_op}"
    query(USERS, f"SELECT graph_id, round({_agg.format('x0')}, 6) AS x0, round({_agg.format('x1')}, 6) AS x1 FROM n GROUP BY graph_id")(_readout)


@query(USERS, "SELECT g.graph_id, coalesce(sum(x0), 0) AS x0, coalesce(sum(x1), 0) AS x1 FROM (SELECT DISTINCT graph_id FROM n UNION SELECT -1) g LEFT JOIN n USING (graph_id) GROUP BY g.graph_id")
def readout_with_empty_graph(spark, d):
    n = tables.transitions(spark, d).nodes
    graphs = n.select("graph_id").distinct().union(spark.range(1).select(F.lit(-1).cast("long")))
    return reduce.readout(n, "sum", graphs, 2).select("graph_id", *(F.col("x")[i].alias(f"x{i}") for i in range(2)))


@query(USERS, "SELECT DISTINCT graph_id, cluster_id FROM s", HARD)
def batch_pooled(spark, d):
    return reduce.batch_pooled(hard(tables.transitions(spark, d)))


@query(USERS, "SELECT graph_id, cluster_id AS node_id, round(sum(weight * x0), 6) AS x0, round(sum(weight * x1), 6) AS x1 FROM n JOIN s USING (graph_id, node_id) GROUP BY ALL", SOFT)
def dense_reduce(spark, d):
    g = tables.transitions(spark, d)
    return flat(reduce.reduced(g.nodes, soft(g), "sum", 2), 2, 6)


# --- connect ---------------------------------------------------------------------------------------------------------

_POOLED = "pe AS (SELECT e.graph_id, a.cluster_id AS src, b.cluster_id AS dst, sum(e.weight) AS weight FROM e JOIN s a ON a.graph_id = e.graph_id AND a.node_id = src JOIN s b ON b.graph_id = e.graph_id AND b.node_id = dst GROUP BY ALL), pn AS (SELECT * FROM pe WHERE src <> dst)"


@query(SUPPLIERS, "SELECT * FROM pe", HARD + ", " + _POOLED)
def partition_connect(spark, d):
    g = tables.suppliers(spark, d)
    return connect.sparse_connect(g.edges, hard(g), self_loops=True)


@query(SUPPLIERS, "SELECT * FROM pn", HARD + ", " + _POOLED)
def connect_no_self_loops(spark, d):
    g = tables.suppliers(spark, d)
    return connect.sparse_connect(g.edges, hard(g))


@query(SUPPLIERS, "SELECT pn.graph_id, src, dst, round(weight / sqrt(a.w) / sqrt(b.w), 6) AS weight FROM pn JOIN dg a ON a.graph_id = pn.graph_id AND a.v = src JOIN dg b ON b.graph_id = pn.graph_id AND b.v = dst", HARD + ", " + _POOLED + ", " + _DEG.format("pn"))
def degree_norm_sparse(spark, d):
    g = tables.suppliers(spark, d)
    return rounded(connect.sparse_connect(g.edges, hard(g), degree_norm=True), "weight")


@query(USERS, "SELECT graph_id, src, dst, round(weight / max(abs(weight)) OVER (PARTITION BY graph_id), 6) AS weight FROM pn", HARD + ", " + _POOLED)
def weight_norm_per_graph(spark, d):
    g = tables.transitions(spark, d)
    return rounded(connect.sparse_connect(g.edges, hard(g), weight_norm=True), "weight")


@query(SUPPLIERS, "SELECT * FROM pn", HARD + ", " + _POOLED)
def eigen_external_connect(spark, d):
    g = tables.suppliers(spark, d)
    return connect.external_connect(g.edges, hard(g))


_DENSE = "se AS (SELECT e.graph_id, a.cluster_id AS src, b.cluster_id AS dst, sum(e.weight * a.weight * b.weight) AS weight FROM e JOIN s a ON a.graph_id = e.graph_id AND a.node_id = src JOIN s b ON b.graph_id = e.graph_id AND b.node_id = dst GROUP BY ALL), sn AS (SELECT * FROM se WHERE src <> dst)"


@query(USERS, "SELECT graph_id, src, dst, round(weight, 6) AS weight FROM se", SOFT + ", " + _DENSE)
def dense_connect(spark, d):
    g = tables.transitions(spark, d)
    return rounded(connect.dense_connect(g.edges, soft(g), self_loops=True, degree_norm=False), "weight")


@query(USERS, "SELECT sn.graph_id, src, dst, round(weight / sqrt(greatest(coalesce(a.w, 0), 1e-8)) / sqrt(greatest(coalesce(b.w, 0), 1e-8)), 6) AS weight FROM sn LEFT JOIN dt a ON a.graph_id = sn.graph_id AND a.v = src LEFT JOIN dt b ON b.graph_id = sn.graph_id AND b.v = dst", SOFT + ", " + _DENSE + ", dt AS (SELECT graph_id, dst AS v, sum(weight) AS w FROM sn GROUP BY ALL)")
def degree_norm_dense_transposed(spark, d):
    g = tables.transitions(spark, d)
    return rounded(connect.dense_connect(g.edges, soft(g)), "weight")


@query(CHATS, "SELECT graph_id, src, dst, round(sum(weight), 6) AS weight FROM (SELECT graph_id, src, dst, weight FROM e WHERE src % 2 = 0 AND dst % 2 = 0 UNION ALL SELECT a.graph_id, a.src, b.src AS dst, a.weight * b.weight / dg.w FROM e a JOIN e b ON a.graph_id = b.graph_id AND a.dst = b.dst AND a.src <> b.src JOIN dg ON dg.graph_id = a.graph_id AND dg.v = a.dst WHERE a.dst % 2 = 1) GROUP BY ALL", _DEG.format("e"))
def kron_by_elimination(spark, d):
    g = tables.conversations(spark, d)
    return rounded(connect.eliminated(g.edges, g.nodes.where("node_id % 2 = 1")), "weight")


@query(CHATS, "SELECT graph_id, src // 2 AS src, dst // 2 AS dst, round(sum(weight), 6) AS weight FROM (SELECT graph_id, src, dst, weight FROM e WHERE src % 2 = 0 AND dst % 2 = 0 UNION ALL SELECT a.graph_id, a.src, b.src AS dst, a.weight * b.weight / dg.w FROM e a JOIN e b ON a.graph_id = b.graph_id AND a.dst = b.dst AND a.src <> b.src JOIN dg ON dg.graph_id = a.graph_id AND dg.v = a.dst WHERE a.dst % 2 = 1) GROUP BY ALL", _DEG.format("e"))
def kron_connect(spark, d):
    """The kernel's Schur complement equals elimination one by one."""
    g = tables.conversations(spark, d)
    kept = g.nodes.where("node_id % 2 = 0").select("graph_id", "node_id", F.floor(F.col("node_id") / 2).alias("cluster_id"), F.lit(1.0).alias("weight"))
    return rounded(kernels.kron(g.nodes, g.edges, kept), "weight")


# --- lift ------------------------------------------------------------------------------------------------------------

_PX = "px AS (SELECT graph_id, cluster_id, sum(s.weight * x0) AS x0, sum(s.weight * x1) AS x1 FROM n JOIN s USING (graph_id, node_id) GROUP BY ALL)"


@query(SUPPLIERS, "SELECT s.graph_id, s.node_id, s.weight * px.x0 AS x0, s.weight * px.x1 AS x1 FROM s JOIN px USING (graph_id, cluster_id)", HARD + ", " + _PX)
def lift_transpose(spark, d):
    g = tables.suppliers(spark, d)
    return flat(lifted(reduce.reduced(g.nodes, hard(g), "sum", 2), hard(g), g.nodes, 2))


@query(SUPPLIERS, "SELECT n.graph_id, n.node_id, coalesce(k.x0, 0) AS x0, coalesce(k.x1, 0) AS x1 FROM n LEFT JOIN (SELECT * FROM n WHERE node_id % 3 = 0) k USING (graph_id, node_id)")
def lift_dropped_nodes_zero(spark, d):
    g = tables.suppliers(spark, d)
    a = g.nodes.where("node_id % 3 = 0").select("graph_id", "node_id", F.col("node_id").alias("cluster_id"), F.lit(1.0).alias("weight"))
    return flat(lifted(reduce.reduced(g.nodes, a, "sum", 2), a, g.nodes, 2))


@query(SUPPLIERS, "SELECT s.graph_id, s.node_id, round(s.weight / t.w * px.x0, 6) AS x0, round(s.weight / t.w * px.x1, 6) AS x1 FROM s JOIN px USING (graph_id, cluster_id) JOIN (SELECT graph_id, cluster_id, sum(weight * weight) AS w FROM s GROUP BY ALL) t USING (graph_id, cluster_id)", HARD + ", " + _PX)
def lift_inverse_hard(spark, d):
    g = tables.suppliers(spark, d)
    return flat(lifted(reduce.reduced(g.nodes, hard(g), "sum", 2), hard(g), g.nodes, 2, "inverse"), 2, 6)


# --- objectives ------------------------------------------------------------------------------------------------------

_DOT = "ed AS (SELECT e.graph_id, src, dst, e.weight AS w, sum(a.weight * b.weight) AS v, sum(abs(a.weight - b.weight)) AS t FROM e JOIN s a ON a.graph_id = e.graph_id AND a.node_id = src JOIN s b ON b.graph_id = e.graph_id AND b.node_id = dst AND b.cluster_id = a.cluster_id GROUP BY ALL), dd AS (SELECT graph_id, src AS node_id, sum(weight) AS d FROM e GROUP BY ALL), ss AS (SELECT graph_id, node_id, sum(weight * weight) AS q FROM s GROUP BY ALL), gr AS (SELECT a.graph_id, a.cluster_id AS k, b.cluster_id AS l, sum(a.weight * b.weight) AS g FROM s a JOIN s b ON a.graph_id = b.graph_id AND a.node_id = b.node_id GROUP BY ALL)"
_DEN = "(SELECT graph_id, sum(d * q) AS den FROM dd JOIN ss USING (graph_id, node_id) GROUP BY graph_id)"


def _loss(name: str, sql: str, f: Callable[[Graph, DataFrame], DataFrame], steps: str = "") -> None:
    def run(spark, d):
        g = tables.transitions(spark, d)
        s = cut(soft(g))
        return rounded(f(Graph(g.nodes, cut(g.edges)), s), "loss")

    run.__name__ = name
    query(USERS, sql, SOFT + ", " + _DOT + steps)(run)


_loss("mincut_loss", f"SELECT graph_id, round(-num / (den + 1e-8), 6) AS loss FROM (SELECT graph_id, sum(w * v) AS num FROM ed GROUP BY graph_id) JOIN {_DEN} USING (graph_id)", lambda g, s: losses.mincut(g.edges, s))
_loss("ortho_loss", "SELECT graph_id, round(sqrt(sum(power(g / nm - CASE WHEN k = l THEN 1 / sqrt(3.0) ELSE 0 END, 2))), 6) AS loss FROM (SELECT *, sqrt(sum(g * g) OVER (PARTITION BY graph_id)) AS nm FROM gr) GROUP BY graph_id", lambda g, s: losses.orthogonality(s))
_loss("hosc_ortho_loss", "SELECT graph_id, round((sqrt(k) - c / sqrt(n)) / (sqrt(k) - 1), 6) AS loss FROM gk JOIN (SELECT graph_id, sum(c) AS c FROM (SELECT graph_id, cluster_id, sqrt(sum(weight * weight)) AS c FROM s GROUP BY ALL) GROUP BY graph_id) USING (graph_id)", lambda g, s: losses.hosc_orthogonality(s))
_loss("link_pred_loss", "SELECT round(sqrt((SELECT sum(power(w - v, 2) - v * v) FROM ed) + (SELECT sum(g * g) FROM gr)), 6) AS loss", lambda g, s: losses.link_prediction(g.edges, s))
_loss("entropy_loss", "SELECT graph_id, round(sum(-weight * ln(weight + 1e-8)) / any_value(n), 6) AS loss FROM s JOIN gk USING (graph_id) GROUP BY graph_id", lambda g, s: losses.entropy(s))
_loss("totvar_loss", "SELECT graph_id, round(sum(w * t) / (2 * count(*)), 6) AS loss FROM ed GROUP BY graph_id", lambda g, s: losses.total_variation(g.edges, s))
_loss("asym_norm_loss", "SELECT graph_id, round((n * (k - 1) - a) / (n * (k - 1)), 6) AS loss FROM (SELECT s.graph_id, any_value(gk.n) AS n, any_value(gk.k) AS k, sum(CASE WHEN s.weight >= q THEN (gk.k - 1) * (s.weight - q) ELSE q - s.weight END) AS a FROM s JOIN gk USING (graph_id) JOIN (SELECT graph_id, cluster_id, weight AS q FROM (SELECT s.*, gk.n, row_number() OVER (PARTITION BY s.graph_id, cluster_id ORDER BY weight DESC, node_id) - 1 AS r FROM s JOIN gk USING (graph_id)) WHERE r = least(floor(n / 3), n - 1)) z USING (graph_id, cluster_id) GROUP BY s.graph_id)", lambda g, s: losses.asymmetric_norm(s))
_loss("just_balance_loss", "SELECT graph_id, round(-sum(sqrt(g + 1e-8)) / sqrt(any_value(n) * any_value(gk.k)), 6) AS loss FROM gr JOIN gk USING (graph_id) WHERE gr.k = gr.l GROUP BY graph_id", lambda g, s: losses.just_balance(s))
_loss("spectral_loss", "SELECT graph_id, round(-(tr - sd / m2) / m2, 6) AS loss FROM (SELECT graph_id, sum(w * v) AS tr, sum(w) AS m2 FROM ed GROUP BY graph_id) JOIN (SELECT graph_id, sum(sd * sd) AS sd FROM (SELECT s.graph_id, cluster_id, sum(weight * d) AS sd FROM s JOIN dd USING (graph_id, node_id) GROUP BY ALL) GROUP BY graph_id) USING (graph_id)", lambda g, s: losses.spectral(g.edges, s))
_loss("cluster_loss", "SELECT graph_id, round(sqrt(sum(c * c)) / any_value(n) * sqrt(3.0) - 1, 6) AS loss FROM (SELECT graph_id, cluster_id, sum(weight) AS c FROM s GROUP BY ALL) JOIN gk USING (graph_id) GROUP BY graph_id", lambda g, s: losses.cluster_size(s))
_POWER = ", a2 AS (SELECT a.graph_id, a.src, b.dst, sum(a.weight * b.weight) AS weight FROM e a JOIN e b ON a.graph_id = b.graph_id AND a.dst = b.src GROUP BY ALL), a3 AS (SELECT a.graph_id, a.src, b.dst, sum(a.weight * b.weight) AS weight FROM a2 a JOIN e b ON a.graph_id = b.graph_id AND a.dst = b.src GROUP BY ALL)"
_loss("ho_mincut_loss", "SELECT graph_id, round(-num / (den + 1e-8), 6) AS loss FROM (SELECT a3.graph_id, sum(a3.weight * a.weight * b.weight) AS num FROM a3 JOIN s a ON a.graph_id = a3.graph_id AND a.node_id = src JOIN s b ON b.graph_id = a3.graph_id AND b.node_id = dst AND a.cluster_id = b.cluster_id GROUP BY ALL) JOIN (SELECT a3.graph_id, sum(a3.weight * q) AS den FROM a3 JOIN ss ON ss.graph_id = a3.graph_id AND ss.node_id = src GROUP BY ALL) USING (graph_id)", lambda g, s: losses.motif_mincut(g.edges, s), _POWER)
_K = [[1.0, -0.5, 0.0], [-0.5, 1.0, -0.25], [0.0, -0.25, 1.0]]
_KM = ", km AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, CAST({v} AS DOUBLE))" for i, r in enumerate(_K) for j, v in enumerate(r)) + ") t(i, j, c)), zz AS (SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, sum(a.weight * c * b.weight) AS z FROM s a JOIN km ON km.i = a.cluster_id JOIN s b ON b.graph_id = a.graph_id AND b.cluster_id = km.j GROUP BY ALL), yy AS (SELECT zz.*, CASE WHEN e.src IS NULL THEN 0.0 ELSE 1.0 END AS y, greatest(-z, 0) + ln(1 + exp(-abs(z))) AS sp FROM zz LEFT JOIN e ON e.graph_id = zz.graph_id AND e.src = zz.src AND e.dst = zz.dst)"
_loss("weighted_bce", "SELECT graph_id, round(sum(y * (c - p) / greatest(p, 1) * sp + (1 - y) * (z + sp)) / any_value(c), 6) AS loss FROM (SELECT *, sum(y) OVER (PARTITION BY graph_id) AS p, count(*) OVER (PARTITION BY graph_id) AS c FROM yy) GROUP BY graph_id", lambda g, s: losses.weighted_bce(g.nodes, g.edges, s, _K), _KM)
_loss("sparse_bce", "SELECT graph_id, round(avg(y * sp + (1 - y) * (z + sp)), 6) AS loss, count(*) AS n_edges FROM (SELECT graph_id, y, z, sp FROM yy WHERE y = 1 UNION ALL SELECT graph_id, y, z, sp FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) AS r FROM yy WHERE y = 0 AND src <> dst) WHERE r <= 4) GROUP BY graph_id", lambda g, s: losses.sparse_bce(g.edges, ops.negative_edges(g.nodes, g.edges, 4), s, _K), _KM)


@query(USERS, "SELECT e.graph_id, sum(e.weight * z.s * y.s) / sum(e.weight) AS loss FROM e JOIN z ON z.graph_id = e.graph_id AND z.node_id = src JOIN z y ON y.graph_id = e.graph_id AND y.node_id = dst GROUP BY ALL", "z AS (SELECT graph_id, node_id, CASE WHEN node_id % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM n)")
def maxcut_loss(spark, d):
    g = tables.transitions(spark, d)
    return losses.maxcut(g.edges, g.nodes.select("graph_id", "node_id", F.when(F.col("node_id") % 2 == 0, 1.0).otherwise(-1.0).alias("score")))


@query(None, "SELECT round(sum(0.5 * power(c - CASE WHEN i = j THEN 1.0 ELSE -1.0 END, 2) / 0.5), 6) AS loss FROM (VALUES " + ", ".join(f"({i}, {j}, CAST({v} AS DOUBLE))" for i, r in enumerate(_K) for j, v in enumerate(r)) + ") t(i, j, c)")
def k_prior(spark, d):
    return spark.range(1).select(F.round(F.lit(losses.k_prior(_K, 1.0, 0.5)), 6).alias("loss"))


def _kl_sql(a: str, b: str, alpha: float, beta: float) -> str:
    """KL(Beta(a, b) | Beta(alpha, beta)) with the engine's own lgamma, and digamma by recurrence to x + 20 and its series."""
    digamma = lambda x: f"(ln({x} + 20) - 0.5 / ({x} + 20) - 1 / (12 * power({x} + 20, 2)) + 1 / (120 * power({x} + 20, 4)) - 1 / (252 * power({x} + 20, 6)) - list_sum(list_transform(range(0, 20), lambda i: 1 / ({x} + i))))"
    return f"(lgamma({alpha}) + lgamma({beta}) - lgamma({alpha} + {beta}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}) + ({a} - {alpha}) * {digamma(a)} + ({b} - {beta}) * {digamma(b)} + ({alpha} - {a} + {beta} - {b}) * {digamma(f'({a} + {b})')})"


@query(USERS, f"SELECT graph_id, round(sum({_kl_sql('(1 + x0 / 10)', '(1 + x1 / 10)', 1.0, 2.0)}), 6) AS loss FROM n GROUP BY graph_id")
def kl_loss(spark, d):
    n = tables.transitions(spark, d).nodes
    return rounded(losses.kl_beta(n.select("graph_id", (1 + F.col("x")[0] / 10).alias("a"), (1 + F.col("x")[1] / 10).alias("b")), 1.0, 2.0), "loss")


# --- message passing and poolers -------------------------------------------------------------------------------------


@query(CHATS, "SELECT graph_id, src, dst, sum(w) AS weight FROM (SELECT graph_id, src, dst, weight * 0.5 AS w FROM e UNION ALL SELECT graph_id, node_id, node_id, 0.0 FROM n UNION ALL SELECT n.graph_id, n.node_id, n.node_id, 1 - 0.5 * coalesce(d.w, 0) FROM n LEFT JOIN (SELECT graph_id, dst AS v, sum(weight) AS w FROM e GROUP BY ALL) d ON d.graph_id = n.graph_id AND d.v = n.node_id) GROUP BY ALL")
def gtv_adj_weights(spark, d):
    g = tables.conversations(spark, d)
    return convolve.gtv_weights(g.nodes, g.edges, 0.5)


@query(CHATS, "SELECT n.graph_id, n.node_id, round(greatest(n.x0 * (1 - coalesce(any_value(dd.d), 0)) + coalesce(sum(ga.w * m.x0), 0), 0), 6) AS x0 FROM n LEFT JOIN ga ON ga.graph_id = n.graph_id AND ga.src = n.node_id LEFT JOIN n m ON m.graph_id = ga.graph_id AND m.node_id = ga.dst LEFT JOIN (SELECT graph_id, dst AS v, sum(w) AS d FROM ga GROUP BY ALL) dd ON dd.graph_id = n.graph_id AND dd.v = n.node_id GROUP BY n.graph_id, n.node_id, n.x0", "ga AS (SELECT e.graph_id, src, dst, e.weight / greatest(abs(a.x0 - b.x0), 0.001) AS w FROM e JOIN n a ON a.graph_id = e.graph_id AND a.node_id = src JOIN n b ON b.graph_id = e.graph_id AND b.node_id = dst)")
def gtv_conv(spark, d):
    g = tables.conversations(spark, d)
    return flat(convolve.gtv_conv(g.nodes, g.edges, [[1.0], [0.0]]), 1, 6)


@query(USERS, "SELECT n.graph_id, n.node_id, round(any_value(n.x0) * 0.5 + coalesce(sum(e.weight * m.x1), 0) * 0.25, 6) AS x0 FROM n LEFT JOIN e ON e.graph_id = n.graph_id AND e.dst = n.node_id LEFT JOIN n m ON m.graph_id = e.graph_id AND m.node_id = e.src GROUP BY ALL")
def graph_conv(spark, d):
    g = tables.transitions(spark, d)
    return flat(convolve.graph_conv(g.nodes, g.edges, [[0.5], [0.0]], [[0.0], [0.25]]), 1, 6)


_PAN = "pk AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY s DESC, node_id) - 1 AS c, count(*) OVER (PARTITION BY graph_id) AS k FROM (SELECT n.graph_id, n.node_id, tanh(0.001 * (any_value(n.x0) + any_value(n.x1)) + 0.001 * coalesce(sum(e.weight), 0)) AS s FROM n LEFT JOIN e ON e.graph_id = n.graph_id AND e.dst = n.node_id GROUP BY ALL) QUALIFY c < ceil(0.5 * k))"


@query(USERS, "SELECT e.graph_id, a.c AS src, b.c AS dst, e.weight FROM e JOIN pk a ON a.graph_id = e.graph_id AND a.node_id = src JOIN pk b ON b.graph_id = e.graph_id AND b.node_id = dst", _PAN)
def pan_pool(spark, d):
    return poolers.pan(tables.transitions(spark, d), beta=(0.001, 0.001)).edges


_SAG = "pk AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY s DESC, node_id) - 1 AS c, count(*) OVER (PARTITION BY graph_id) AS k FROM (SELECT n.graph_id, n.node_id, any_value(n.x0) + any_value(n.x1) + coalesce(sum(m.x0 + m.x1), 0) AS s FROM n LEFT JOIN e ON e.graph_id = n.graph_id AND e.dst = n.node_id LEFT JOIN n m ON m.graph_id = e.graph_id AND m.node_id = e.src GROUP BY ALL) QUALIFY c < ceil(0.5 * k))"


@query(USERS, "SELECT e.graph_id, a.c AS src, b.c AS dst, e.weight FROM e JOIN pk a ON a.graph_id = e.graph_id AND a.node_id = src JOIN pk b ON b.graph_id = e.graph_id AND b.node_id = dst WHERE a.c <> b.c", _SAG)
def sag_pool(spark, d):
    return poolers.sag(tables.transitions(spark, d), act="identity").edges


def _named(name: str, build: Callable[[SparkSession, str], DataFrame]) -> None:
    build.__name__ = name
    query()(build)


_ASAP = """el AS (SELECT * FROM e UNION ALL SELECT graph_id, node_id, node_id, 1.0 FROM n),
fr AS (SELECT el.*, n.x0, n.x1 FROM el JOIN n ON n.graph_id = el.graph_id AND n.node_id = el.src),
aq AS (SELECT graph_id, dst, 0.5 * (max(x0) + max(x1)) AS q FROM fr GROUP BY ALL),
ar AS (SELECT fr.*, CASE WHEN q + 0.5 * (x0 + x1) >= 0 THEN 1.0 ELSE 0.2 END * (q + 0.5 * (x0 + x1)) AS a FROM fr JOIN aq USING (graph_id, dst)),
ae AS (SELECT *, exp(a - max(a) OVER (PARTITION BY graph_id, dst)) AS ex FROM ar),
ax AS (SELECT graph_id, dst AS node_id, sum(ex * x0) / sum(ex) AS x0, sum(ex * x1) / sum(ex) AS x1 FROM ae GROUP BY ALL)"""


@query(CHATS, "SELECT graph_id, node_id, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM ax", _ASAP)
def asap_attention(spark, d):
    """Features of each node's cluster of in-neighbours, before the best are chosen."""
    return flat(poolers.asap_features(tables.conversations(spark, d), 2, att=[0.5] * 4)[0], 2, 6)


@query(CHATS, "SELECT el.graph_id, a.c AS src, b.c AS dst, el.weight FROM el JOIN pk a ON a.graph_id = el.graph_id AND a.node_id = src JOIN pk b ON b.graph_id = el.graph_id AND b.node_id = dst WHERE a.c <> b.c",
       _ASAP + ", sc AS (SELECT ax.graph_id, ax.node_id, 1 / (1 + exp(-(0.5 * (any_value(ax.x0) + any_value(ax.x1)) * (1 + sum(el.weight)) - sum(el.weight * 0.5 * (m.x0 + m.x1))))) AS s FROM ax JOIN el ON el.graph_id = ax.graph_id AND el.dst = ax.node_id JOIN ax m ON m.graph_id = el.graph_id AND m.node_id = el.src GROUP BY ALL), pk AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY s DESC, node_id) - 1 AS c, count(*) OVER (PARTITION BY graph_id) AS k FROM sc QUALIFY c < ceil(0.5 * k))")
def asap_pool(spark, d):
    return poolers.asap(tables.conversations(spark, d), att=[0.5] * 4).edges


_EC = "er AS (SELECT e.graph_id, src, dst, 0.5 * (a.x0 + a.x1 + b.x0 + b.x1) AS r FROM e JOIN n a ON a.graph_id = e.graph_id AND a.node_id = src JOIN n b ON b.graph_id = e.graph_id AND b.node_id = dst), ex AS (SELECT *, exp(r - max(r) OVER (PARTITION BY graph_id, dst)) AS x FROM er), es AS (SELECT graph_id, src, dst, x / sum(x) OVER (PARTITION BY graph_id, dst) + 0.5 AS s FROM ex)"


@query(CHATS, "SELECT * FROM p0", _EC + ", " + _KEYED.format("s", "es") + ", " + _matching_sql(12, "s DESC, src, dst", "ke") + ", " + _MATCHED)
def ec_pool(spark, d):
    return poolers.ec(tables.conversations(spark, d), p=[0.5] * 4).edges


@query(USERS, "SELECT sn.graph_id, src, dst, round(weight / sqrt(greatest(coalesce(a.w, 0), 1e-8)) / sqrt(greatest(coalesce(b.w, 0), 1e-8)), 6) AS weight FROM sn LEFT JOIN dt a ON a.graph_id = sn.graph_id AND a.v = src LEFT JOIN dt b ON b.graph_id = sn.graph_id AND b.v = dst", SOFT + ", " + _DENSE + ", dt AS (SELECT graph_id, dst AS v, sum(weight) AS w FROM sn GROUP BY ALL)")
def mincut_pool(spark, d):
    return rounded(poolers.mincut(tables.transitions(spark, d), 3, LAYERS).edges, "weight")


def _objective(name: str, sql: str, build: Callable[[Graph], DataFrame]) -> None:
    """An objective of a soft pooler over the memberships of SOFT; sql: that of the objective itself."""

    def run(spark, d):
        return rounded(build(tables.transitions(spark, d)), "loss")

    run.__name__ = name
    query()(run)
    _SQL[name] = sql


_objective("diff_pool", _SQL["link_pred_loss"], lambda g: poolers.diff(g, 3, LAYERS).loss["link_loss"])
_objective("dmon_pool", _SQL["spectral_loss"], lambda g: poolers.dmon(g, 3, LAYERS).loss["spectral_loss"])
_objective("jb_pool", _SQL["just_balance_loss"], lambda g: poolers.jb(g, 3, LAYERS).loss["balance_loss"])
_objective("acc_pool", _SQL["totvar_loss"], lambda g: poolers.acc(g, 3, LAYERS).loss["total_variation_loss"])
_CUT = "-num / (den + 1e-8)"
_HOSC = {n: _SQL[n].replace(f"round({_CUT}, 6)", _CUT) for n in ("mincut_loss", "ho_mincut_loss")}
_MAIN = "SELECT graph_id, " + _CUT
_objective("hosc_pool", _HOSC["ho_mincut_loss"].replace(_MAIN, "SELECT graph_id, round(0.5 / 3 * u.loss + 0.5 / 3 * w.loss, 6) AS loss FROM (" + _HOSC["mincut_loss"][_HOSC["mincut_loss"].index(_MAIN) :] + ") u JOIN (" + _MAIN) + ") w USING (graph_id)", lambda g: poolers.hosc(g, 3, LAYERS).loss["hosc_loss"])

_STICKS = [([[0.02, 0.0, 0.01, 0.0], [0.0, 0.03, 0.0, -0.02]], [0.1, 0.0, 0.0, 0.0])]
_V = f"v1 AS (SELECT graph_id, node_id, {_SP.format('(x0 * 0.02 + 0.1)')} AS a0, {_SP.format('(x1 * 0.03)')} AS a1, {_SP.format('(x0 * 0.01)')} AS b0, {_SP.format('(x1 * -0.02)')} AS b1 FROM n), v2 AS (SELECT graph_id, node_id, a0 / (a0 + b0) AS v0, a1 / (a1 + b1) AS v1 FROM v1), s AS (SELECT graph_id, node_id, CAST(0 AS BIGINT) AS cluster_id, v0 AS weight FROM v2 UNION ALL SELECT graph_id, node_id, 1, (1 - v0) * v1 FROM v2 UNION ALL SELECT graph_id, node_id, 2, (1 - v0) * (1 - v1) FROM v2)"
_KI = _KM[_KM.index("zz AS") :].replace("JOIN km ON km.i = a.cluster_id JOIN s b ON b.graph_id = a.graph_id AND b.cluster_id = km.j", "JOIN s b ON b.graph_id = a.graph_id").replace("* c *", "* CASE WHEN a.cluster_id = b.cluster_id THEN 1.0 ELSE -1.0 END *")


@query(USERS, f"SELECT q.graph_id, round(q.loss, 6) AS quality, round(k.kl / q.c, 6) AS kl, round(364.5 / q.c, 6) AS k_prior FROM (SELECT graph_id, avg(y * sp + (1 - y) * (z + sp)) AS loss, count(*) AS c FROM (SELECT graph_id, y, z, sp FROM yy WHERE y = 1 UNION ALL SELECT graph_id, y, z, sp FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) AS r FROM yy WHERE y = 0 AND src <> dst) WHERE r <= 4) GROUP BY graph_id) q JOIN (SELECT graph_id, sum({_kl_sql('a0', 'b0', 1.0, 1.0)} + {_kl_sql('a1', 'b1', 1.0, 1.0)}) AS kl FROM v1 GROUP BY graph_id) k USING (graph_id)", _V + ", " + _KI)
def bnpool(spark, d):
    """The three objectives, with non-edges by id."""
    g = tables.transitions(spark, d)
    loss = poolers.bnpool(g, 3, _STICKS, negatives=ops.negative_edges(g.nodes, g.edges, 4)).loss
    parts = [loss[n].select("graph_id", F.col("loss").alias(c)) for n, c in (("quality", "quality"), ("kl", "kl"), ("K_prior", "k_prior"))]
    return rounded(parts[0].join(parts[1], "graph_id").join(parts[2], "graph_id"), "quality", "kl", "k_prior")


@query(CHATS, "SELECT sn.graph_id, src, dst, round(weight / sqrt(greatest(coalesce(a.w, 0), 1e-8)) / sqrt(greatest(coalesce(b.w, 0), 1e-8)), 6) AS weight FROM sn LEFT JOIN dt a ON a.graph_id = sn.graph_id AND a.v = src LEFT JOIN dt b ON b.graph_id = sn.graph_id AND b.v = dst",
       _LEAD + """, lr AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) AS rn FROM lead), li AS (SELECT graph_id, node_id AS l, x0, x1, rn, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS cluster_id FROM lr WHERE leader),
lx AS (SELECT a.graph_id, a.node_id, a.leader, b.l, b.cluster_id, exp((a.x0 * b.x0 + a.x1 * b.x1) / greatest(sqrt(a.x0 * a.x0 + a.x1 * a.x1) * sqrt(b.x0 * b.x0 + b.x1 * b.x1), 1e-8) / greatest(abs(a.rn - b.rn), 1)) AS ex FROM lr a JOIN li b USING (graph_id)),
s AS (SELECT graph_id, node_id, cluster_id, CASE WHEN leader THEN CASE WHEN node_id = l THEN 1.0 ELSE 0.0 END ELSE ex / sum(ex) OVER (PARTITION BY graph_id, node_id) END AS weight FROM lx), """ + _DENSE + ", dt AS (SELECT graph_id, dst AS v, sum(weight) AS w FROM sn GROUP BY ALL)")
def lap_pool(spark, d):
    return rounded(poolers.lap(tables.conversations(spark, d), True).edges, "weight")


_NET = {"initial": ([[0.001, 0.0], [0.0, 0.5]], [0.1, -0.1]), "layers": [([[1.0, 0.5], [-0.5, 1.0]], [0.0, 0.1])], "mlp": [([[1.0], [-1.0]], [0.05])], "final": ([[2.0]], [0.1])}


_MAXCUT = _DEG.format("e") + ", dl AS (SELECT e.graph_id, src, dst, weight * 2.0 / sqrt(a.w * b.w) AS weight FROM e JOIN dg a ON a.graph_id = e.graph_id AND a.v = src JOIN dg b ON b.graph_id = e.graph_id AND b.v = dst WHERE src <> dst UNION ALL SELECT graph_id, node_id, node_id, -1.0 FROM n), mp AS (SELECT dl.graph_id, dl.src AS node_id, sum(dl.weight * (0.001 * n.x0 + 0.1)) AS p0, sum(dl.weight * (0.5 * n.x1 - 0.1)) AS p1 FROM dl JOIN n ON n.graph_id = dl.graph_id AND n.node_id = dl.dst GROUP BY ALL)"


@query(CHATS, "SELECT graph_id, node_id, round(tanh(2 * greatest(tanh(p0 - 0.5 * p1) - tanh(0.5 * p0 + p1 + 0.1) + 0.05, 0) + 0.1), 6) AS score FROM mp", _MAXCUT)
def maxcut_scores(spark, d):
    """The score network with given weights: affine, propagation, one layer, a final sum."""
    g = tables.conversations(spark, d)
    return rounded(select.maxcut_scores(g.nodes, ops.delta_gcn(g.nodes, g.edges, 2.0), _NET), "score")


_named("nmf_select", lambda spark, d: kernels.nmf(*_both(tables.conversations(spark, d)), 2))
_named("eigen_select", lambda spark, d: kernels.eigen_select(*_both(tables.conversations(spark, d)), 2))
_named("eigen_reduce", lambda spark, d: flat(poolers.eigen(tables.conversations(spark, d), 2, 2).nodes, 4))
_named("eigen_lift", lambda spark, d: _eigen_lift(tables.conversations(spark, d)))
_named("sep_select", lambda spark, d: kernels.sep(*_both(tables.conversations(spark, d))))
_named("sep_levels", lambda spark, d: kernels.sep_levels(*_both(tables.conversations(spark, d)), 2))
_named("dp_sample", lambda spark, d: select.dp_select(tables.transitions(spark, d).nodes, [([[0.02, 0.0, 0.01, 0.0], [0.0, 0.03, 0.0, -0.02]], None)], seed=1))
_named("pooler_abilities", lambda spark, d: poolers.abilities(spark))


def _both(g: Graph) -> tuple[DataFrame, DataFrame]:
    return g.nodes, g.edges


def _eigen_lift(g: Graph) -> DataFrame:
    p = poolers.eigen(g, 2, 2)
    return flat(eigen_lifted(p.nodes, p.extra["theta"], 2))


@query(CHATS, "SELECT 0 AS level, src // 1 AS src, dst // 1 AS dst, weight, graph_id FROM e")
def precoarsen_identity(spark, d):
    return poolers.tagged(poolers.precoarsened(tables.conversations(spark, d), ["nopool"]), "edges").select("level", "src", "dst", "weight", "graph_id")


#: The independent set of the graph that the matching leaves (n1, e1), its tables set apart from the matching's.
_SECOND = re.sub(r"\b(sc|r|z|[lwq]\d+|[mc]\d+_\d+)\b", r"y\1", re.sub(r"\b([ne])\b", r"\g<1>1", _mis_sql(1, 10, _DEGREE_SCORE)))


@query(CHATS, "SELECT 0 AS level, graph_id, src, dst, weight FROM p0 UNION ALL SELECT 1, src // 1000, a.c, b.c, sum(weight) FROM e1 JOIN cy a ON a.node_id = src JOIN cy b ON b.node_id = dst WHERE a.c <> b.c GROUP BY ALL",
       _KEYED.format("weight", "e") + ", " + _matching_sql(12, "s DESC, src, dst", "ke") + ", " + _MATCHED + ", n1 AS MATERIALIZED (SELECT DISTINCT graph_id * 1000 + c AS node_id FROM cm), e1 AS MATERIALIZED (SELECT graph_id * 1000 + src AS src, graph_id * 1000 + dst AS dst, weight FROM p0), " + _SECOND + ", cy AS (SELECT yq1.node_id, i.c FROM yq1 JOIN (SELECT rk, row_number() OVER (PARTITION BY node_id // 1000 ORDER BY node_id) - 1 AS c FROM yz) i ON i.rk = yq1.m)")
def precoarsen_levels(spark, d):
    return poolers.tagged(poolers.precoarsened(tables.conversations(spark, d), ["graclus", ("kmis", {"order_k": 1})]), "edges")


@query(CHATS, "SELECT graph_id, node_id, round(ex / sum(ex) OVER (PARTITION BY graph_id), 6) AS p FROM (SELECT *, exp(x0 / 100 - max(x0 / 100) OVER (PARTITION BY graph_id)) AS ex FROM n)")
def segment_softmax_nodes(spark, d):
    return rounded(tables.conversations(spark, d).nodes.select("graph_id", "node_id", segment_softmax(F.col("x")[0] / 100, "graph_id").alias("p")), "p")


# --- whole assignments, labels and plans -----------------------------------------------------------------------------


@query(USERS, "SELECT n.graph_id, n.node_id, coalesce(k.r, 0) AS label FROM n LEFT JOIN (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) AS r FROM n WHERE x0 > 10) k USING (graph_id, node_id)")
def one_hot_labels(spark, d):
    n = tables.transitions(spark, d).nodes
    return assignments.one_hot_labels(n, n.where(F.col("x")[0] > 10))


@query(USERS, "SELECT s.graph_id, node_id, CAST(cluster_id + o.k AS BIGINT) AS cluster_id, weight FROM s JOIN (SELECT graph_id, coalesce(sum(k) OVER (ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM (SELECT graph_id, max(cluster_id) + 1 AS k FROM s GROUP BY graph_id)) o USING (graph_id)", HARD)
def block_clusters(spark, d):
    return assignments.block_clusters(hard(tables.transitions(spark, d)))


@query(CHATS, "SELECT 0 AS part, graph_id, node_id, cluster_id, weight FROM s UNION ALL SELECT 1, graph_id, node_id, cluster_id - min(cluster_id) OVER (PARTITION BY graph_id), weight FROM s", HARD)
def collate_assigns(spark, d):
    """Two assignments of all graphs as one table; the second has its clusters numbered from 0 on."""
    a = hard(tables.conversations(spark, d))
    both = assignments.collated_assigns([x.withColumn("own", F.col("graph_id")) for x in (a, assignments.rebased(a))])
    return both.select(F.col("graph_id").cast("int").alias("part"), F.col("own").alias("graph_id"), "node_id", "cluster_id", "weight")


@query(USERS, "SELECT e.graph_id, a.c AS src, b.c AS dst, e.weight FROM e JOIN k a ON a.graph_id = e.graph_id AND a.node_id = src JOIN k b ON b.graph_id = e.graph_id AND b.node_id = dst WHERE src <> dst", "k AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS c FROM n WHERE node_id < 6)")
def compact_supernodes(spark, d):
    """Supernodes with gaps between their ids, of which a mask lets the first twelve through where they have members."""
    g = tables.transitions(spark, d)
    a = cut(g.nodes.select("graph_id", "node_id", (2 * F.col("node_id")).alias("cluster_id"), F.lit(1.0).alias("weight")))
    p = poolers.by_assignment(g, a)
    return assignments.compacted(p.nodes, p.edges, ops.out_mask(a, 12)).edges


@query(USERS, "SELECT DISTINCT graph_id, node_id % 7 AS child, node_id % 7 % 3 AS parent FROM n")
def hierarchy_parents(spark, d):
    n = tables.transitions(spark, d).nodes
    return assignments.parents(n.select("graph_id", (F.col("node_id") % 7).alias("child"), (F.col("node_id") % 7 % 3).alias("parent")))


@query(SUPPLIERS, "SELECT t.graph_id, round(-(a + b) / vol, 6) AS entropy FROM (SELECT graph_id, sum(weight) AS vol FROM ce GROUP BY ALL) t JOIN (SELECT o.graph_id, sum(v * log2(v / vc)) AS a FROM (SELECT graph_id, c, src, sum(weight) AS v FROM ce GROUP BY ALL) o JOIN cv USING (graph_id, c) GROUP BY ALL) USING (graph_id) JOIN (SELECT cv.graph_id, sum(g * log2(vc / (SELECT sum(weight) FROM ce))) AS b FROM cv GROUP BY ALL) USING (graph_id)",
       HARD + ", ce AS (SELECT e.*, a.cluster_id AS c, b.cluster_id AS d FROM e JOIN s a ON a.node_id = src JOIN s b ON b.node_id = dst WHERE src <> dst), cv AS (SELECT graph_id, c, sum(weight) AS vc, sum(CASE WHEN c <> d THEN weight ELSE 0 END) AS g FROM ce GROUP BY ALL)")
def tree_entropy(spark, d):
    g = tables.suppliers(spark, d)
    return rounded(assignments.partition_entropy(g.edges, hard(g)), "entropy")


@query(CHATS, "SELECT e.graph_id, src, dst, round(weight * 0.85 / sqrt(a.w * b.w), 6) AS weight, CAST(src AS DOUBLE) AS a0, CAST(dst * 2 AS DOUBLE) AS a1 FROM e JOIN dg a ON a.graph_id = e.graph_id AND a.v = src JOIN dg b ON b.graph_id = e.graph_id AND b.v = dst WHERE src <> dst UNION ALL SELECT graph_id, node_id, node_id, 0.15, 0.0, 0.0 FROM n", _DEG.format("e"))
def normalize_adj_attributes(spark, d):
    g = tables.conversations(spark, d)
    e = g.edges.withColumn("attr", F.array(F.col("src").cast("double"), 2.0 * F.col("dst")))
    out = ops.delta_gcn_attributes(g.nodes, e, 2, 0.85)
    return rounded(out.select("graph_id", "src", "dst", "weight", F.col("attr")[0].alias("a0"), F.col("attr")[1].alias("a1")), "weight")


@query(USERS, "SELECT graph_id, round(p, 6) AS share, CASE WHEN p < 0.5 THEN 'dense' ELSE 'sparse' END AS method, CAST(CASE WHEN p < 0.5 THEN c * (c - 1) WHEN p <= CAST(2 AS DOUBLE) / 3 THEN 15 ELSE floor(10 / p) END AS BIGINT) AS tries FROM (SELECT g.graph_id, c, 1 - coalesce(m, 0) / greatest(c * (c - 1), 1) AS p FROM (SELECT graph_id, count(*) AS c FROM n GROUP BY ALL) g LEFT JOIN (SELECT graph_id, count(*) AS m FROM e WHERE src <> dst GROUP BY ALL) USING (graph_id))")
def negative_sampling_plan(spark, d):
    g = tables.transitions(spark, d)
    return rounded(ops.sampling_plan(g.nodes, g.edges, 10), "share")


@query(None, "SELECT (d + l * sqrt(d)) / n AS within, (d - l * sqrt(d)) / n AS between_blocks FROM (VALUES (CAST(10 AS DOUBLE), CAST(1 AS DOUBLE), CAST(100 AS DOUBLE))) t(d, l, n)")
def csbm_probabilities(spark, d):
    inside, outside = generators.edge_probabilities(10, 1, 100)
    return spark.range(1).select(F.lit(inside).alias("within"), F.lit(outside).alias("between_blocks"))


_GSET = [(1, 2, 1.0), (1, 3, -1.0), (2, 4, 2.5), (5, 4, 1.0)]


@query(None, "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({u}, {v}, CAST({w} AS DOUBLE))" for u, v, w in _GSET) + ") t(u, v, w)) SELECT CAST(0 AS BIGINT) AS graph_id, CAST(u - 1 AS BIGINT) AS src, CAST(v - 1 AS BIGINT) AS dst, w AS weight FROM t UNION ALL SELECT 0, v - 1, u - 1, w FROM t")
def gset_parse(spark, d):
    """A text file with its header and a line that is no edge."""
    path = scratch(spark, "gset")
    spark.createDataFrame([("6 4",), *((f"{u} {v} {w}",) for u, v, w in _GSET), ("a comment of more than three words",)], "value string").coalesce(1).write.text(path)
    return generators.gset(spark, path).edges


for _kind, _made in {"path": "SELECT i AS s, i + 1 AS t FROM (SELECT unnest(range(0, 8)) AS i)", "full": "SELECT i AS s, j AS t FROM (SELECT unnest(range(0, 9)) AS i), (SELECT unnest(range(0, 9)) AS j) WHERE i < j"}.items():

    def _generated(spark, d, kind=_kind):
        return getattr(generators, kind)(spark, 9).edges.drop("weight")

    _generated.__name__ = f"generator_{_kind}"
    query(None, f"WITH u AS ({_made}) SELECT CAST(0 AS BIGINT) AS graph_id, s AS src, t AS dst FROM u UNION ALL SELECT 0, t, s FROM u")(_generated)


# --- learned readouts, distances and components ----------------------------------------------------------------------


def _columns(rows: DataFrame, dims: int) -> DataFrame:
    return rows.select("graph_id", *(F.round(F.col("x")[i], 6).alias(f"x{i}") for i in range(dims)))


@query(USERS, "SELECT graph_id, sum(x0) AS x0, sum(x1) AS x1, round(avg(x0), 6) AS x2, round(avg(x1), 6) AS x3, max(x0) AS x4, max(x1) AS x5 FROM n GROUP BY graph_id")
def readout_multi(spark, d):
    return _columns(reduce.readout(tables.transitions(spark, d).nodes, "multi", None, 2), 6)


@query(USERS, "SELECT graph_id, round(0.5 * h0 - 0.25 * h1, 6) AS x0 FROM (SELECT graph_id, sum(greatest(0.1 * x0 - 0.2 * x1, 0)) AS h0, sum(greatest(0.3 * x1 - 0.1 * x0, 0)) AS h1 FROM n GROUP BY graph_id)")
def readout_deep_sets(spark, d):
    return _columns(reduce.readout(tables.transitions(spark, d).nodes, "deep_sets", None, 2, inner=[[0.1, -0.1], [-0.2, 0.3]], outer=[[0.5], [-0.25]]), 1)


@query(USERS, "SELECT graph_id, round(0.5 * sum(tanh(0.1 * x0 - 0.2 * x1)), 6) AS x0 FROM n GROUP BY graph_id")
def readout_mlp(spark, d):
    return _columns(reduce.readout(tables.transitions(spark, d).nodes, "mlp", None, 2, inner=[[0.1], [-0.2]], outer=[[0.5]], act="tanh"), 1)


@query(USERS, "SELECT graph_id, round(sum(g * x0) / sum(g), 6) AS x0, round(sum(g * x1) / sum(g), 6) AS x1 FROM (SELECT *, exp(0.1 * x0 - 0.2 * x1) AS g FROM n) GROUP BY graph_id")
def readout_attentional(spark, d):
    return _columns(reduce.readout(tables.transitions(spark, d).nodes, "attentional", None, 2, gate=[0.1, -0.2]), 2)


def _gate(inputs: list[str], states: list[str], weights: dict, j: int) -> tuple[str, str]:
    """The two parts of a recurrent unit's gate in SQL: from its inputs and from its states."""
    return tuple("(" + " + ".join(f"{v} * ({w[i][j]!r})" for i, v in enumerate(names)) + ")" for names, w in ((inputs, weights["in"]), (states, weights["own"])))


def _sigmoid(*parts: str) -> str:
    return f"(1 / (1 + exp(-({' + '.join(parts)}))))"


def _lstm_cell(inputs: list[str], states: list[str], memory: list[str], w: dict) -> tuple[list[str], list[str]]:
    c = [f"({_sigmoid(*_gate(inputs, states, w, 2 + k))} * {memory[k]} + {_sigmoid(*_gate(inputs, states, w, k))} * tanh({' + '.join(_gate(inputs, states, w, 4 + k))}))" for k in (0, 1)]
    return [f"({_sigmoid(*_gate(inputs, states, w, 6 + k))} * tanh({c[k]}))" for k in (0, 1)], c


def _gru_cell(inputs: list[str], states: list[str], w: dict) -> list[str]:
    out = []
    for k in (0, 1):
        z, (a, b) = _sigmoid(*_gate(inputs, states, w, 2 + k)), _gate(inputs, states, w, 4 + k)
        out.append(f"((1 - {z}) * tanh({a} + {_sigmoid(*_gate(inputs, states, w, k))} * {b}) + {z} * {states[k]})")
    return out


_X, _S, _C = ["q.x0", "q.x1"], ["r.s0", "r.s1"], ["r.c0", "r.c1"]
_LSTM_W, _GRU_W, _SET_W = ({"in": hashed_weights(ins, gates * 2, 1), "own": hashed_weights(2, gates * 2, 2)} for ins, gates in ((2, 4), (2, 3), (4, 4)))


def _unrolled(state: list[str], memory: list[str]) -> str:
    """A recurrent reader in SQL: one step of a recursion for each node of a graph, in their order."""
    return f"WITH RECURSIVE {USERS}, sq AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) AS t FROM n), r AS (SELECT graph_id, CAST(0 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS s0, CAST(0 AS DOUBLE) AS s1, CAST(0 AS DOUBLE) AS c0, CAST(0 AS DOUBLE) AS c1 FROM (SELECT DISTINCT graph_id FROM n) UNION ALL SELECT q.graph_id, q.t, {state[0]}, {state[1]}, {memory[0]}, {memory[1]} FROM r JOIN sq q ON q.graph_id = r.graph_id AND q.t = r.t + 1) SELECT graph_id, round(s0, 6) AS x0, round(s1, 6) AS x1 FROM r QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY t DESC) = 1"


@query(None, _unrolled(*_lstm_cell(_X, _S, _C, _LSTM_W)))
def readout_lstm(spark, d):
    return _columns(reduce.readout(tables.transitions(spark, d).nodes, "lstm", None, 2, weights=_LSTM_W), 2)


@query(None, _unrolled(_gru_cell(_X, _S, _GRU_W), _C))
def readout_gru(spark, d):
    return _columns(reduce.readout(tables.transitions(spark, d).nodes, "gru", None, 2, weights=_GRU_W), 2)


_SET = _lstm_cell(["0", "0", "m0", "m1"], ["0", "0"], ["0", "0"], _SET_W)[0]


@query(USERS, "SELECT graph_id, round(any_value(s0), 6) AS x0, round(any_value(s1), 6) AS x1, round(sum(g * x0) / sum(g), 6) AS x2, round(sum(g * x1) / sum(g), 6) AS x3 FROM (SELECT *, exp(x0 * s0 + x1 * s1 - max(x0 * s0 + x1 * s1) OVER (PARTITION BY graph_id)) AS g FROM n JOIN st USING (graph_id)) GROUP BY graph_id",
       f"mn AS (SELECT graph_id, avg(x0) AS m0, avg(x1) AS m1 FROM n GROUP BY graph_id), st AS (SELECT graph_id, {_SET[0]} AS s0, {_SET[1]} AS s1 FROM mn)")
def readout_set2set(spark, d):
    """Two steps: the first attends to all nodes alike, as states start from zero."""
    return _columns(reduce.readout(tables.transitions(spark, d).nodes, "set2set", None, 2, weights=_SET_W), 4)


@query(CHATS, "SELECT a.graph_id, a.node_id, b.node_id AS leader, abs(a.t - b.t) AS hops FROM sq a JOIN sq b ON a.graph_id = b.graph_id AND b.node_id % 3 = 0", "sq AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) AS t FROM n)")
def hop_distances(spark, d):
    """Breadth-first distances to every third turn; a conversation is a path."""
    g = tables.conversations(spark, d)
    return kernels.hops(g.nodes, g.edges, g.nodes.where("node_id % 3 = 0"))


@query(None, f"WITH RECURSIVE {CHATS}, h AS (SELECT graph_id, src, dst FROM e WHERE src % 3 <> 2 AND dst % 3 <> 2), r AS (SELECT graph_id, node_id, node_id AS c FROM n UNION SELECT h.graph_id, h.dst, r.c FROM r JOIN h ON h.graph_id = r.graph_id AND h.src = r.node_id) SELECT graph_id, node_id, min(c) AS component FROM r GROUP BY ALL")
def graph_components(spark, d):
    """Components of conversations that lose the edges of every third turn."""
    g = tables.conversations(spark, d)
    return ops.components(g.nodes, g.edges.where("src % 3 <> 2 and dst % 3 <> 2"))


@query(CHATS, "SELECT graph_id, c AS src, c + 1 AS dst, CAST(0.5 AS DOUBLE) AS weight FROM ps UNION ALL SELECT graph_id, c + 1, c, 0.5 FROM ps", "ps AS (SELECT graph_id, unnest(range(0, CAST(ceil(count(*) / 2.0) AS BIGINT) - 1)) AS c FROM n GROUP BY graph_id)")
def ndp_pool(spark, d):
    """On a path the split is every other node; a node that goes leaves half its two unit weights between its neighbours."""
    return rounded(poolers.ndp(tables.conversations(spark, d)).edges, "weight")


_PICK = "SELECT graph_id, dst AS node_id, cluster_id FROM (SELECT e.graph_id, e.dst, k.cluster_id, row_number() OVER (PARTITION BY e.graph_id, e.dst ORDER BY count(*) DESC, k.cluster_id) AS r FROM e JOIN {0} k ON k.graph_id = e.graph_id AND k.node_id = e.src LEFT JOIN {0} o ON o.graph_id = e.graph_id AND o.node_id = e.dst WHERE o.node_id IS NULL GROUP BY e.graph_id, e.dst, k.cluster_id) WHERE r = 1"


@query(CHATS, "SELECT graph_id, src, dst, round(weight / max(abs(weight)) OVER (PARTITION BY graph_id), 6) AS weight FROM (SELECT e.graph_id, a.cluster_id AS src, b.cluster_id AS dst, sum(weight) AS weight FROM e JOIN k5 a ON a.graph_id = e.graph_id AND a.node_id = src JOIN k5 b ON b.graph_id = e.graph_id AND b.node_id = dst WHERE a.cluster_id <> b.cluster_id GROUP BY ALL)",
       _MAXCUT + ", sc AS (SELECT graph_id, node_id, tanh(2 * greatest(tanh(p0 - 0.5 * p1) - tanh(0.5 * p0 + p1 + 0.1) + 0.05, 0) + 0.1) AS s FROM mp), k0 AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY s DESC, node_id) - 1 AS cluster_id FROM sc QUALIFY cluster_id < ceil(0.5 * count(*) OVER (PARTITION BY graph_id))), " + ", ".join(f"k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} UNION ALL {_PICK.format(f'k{i}')})" for i in range(5)))
def maxcut_pool(spark, d):
    return rounded(poolers.maxcut(tables.conversations(spark, d), net=_NET).edges, "weight")


_TWO = "s AS (SELECT graph_id, node_id, CAST(0 AS BIGINT) AS cluster_id, (1 + node_id % 3) / 4.0 AS weight FROM n UNION ALL SELECT graph_id, node_id, 1, 1 - (1 + node_id % 3) / 4.0 FROM n)"


@query(USERS, "SELECT graph_id, node_id, round(r0 * p.x0 + r1 * q.x0, 6) AS x0, round(r0 * p.x1 + r1 * q.x1, 6) AS x1 FROM iv JOIN (SELECT * FROM px WHERE cluster_id = 0) p USING (graph_id) JOIN (SELECT * FROM px WHERE cluster_id = 1) q USING (graph_id)",
       _TWO + ", " + _PX + ", w AS (SELECT graph_id, node_id, (1 + node_id % 3) / 4.0 AS a, 1 - (1 + node_id % 3) / 4.0 AS b FROM n), gm AS (SELECT graph_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, count(*) AS c FROM w GROUP BY graph_id), iv AS (SELECT graph_id, node_id, CASE WHEN aa * bb - ab * ab > 1e-9 THEN (a * bb - b * ab) / (aa * bb - ab * ab) ELSE a / (c * (a * a + b * b)) END AS r0, CASE WHEN aa * bb - ab * ab > 1e-9 THEN (b * aa - a * ab) / (aa * bb - ab * ab) ELSE b / (c * (a * a + b * b)) END AS r1 FROM w JOIN gm USING (graph_id))")
def lift_inverse_soft(spark, d):
    """Two memberships a node, whose Gram matrix has a closed inverse; where all rows are equal, the inverse of rank one."""
    g = tables.transitions(spark, d)
    a = (1 + F.col("node_id") % 3) / 4.0
    s = g.nodes.select("graph_id", "node_id", F.posexplode(F.array(a, 1 - a)).alias("cluster_id", "weight")).withColumn("cluster_id", F.col("cluster_id").cast("long"))
    return flat(lifted(reduce.reduced(g.nodes, s, "sum", 2), s, g.nodes, 2, "soft_inverse"), 2, 6)
