"""The tables that all operators share.

nodes:  graph_id long, node_id long, x array<double>
edges:  graph_id long, src long, dst long, weight double (null: the graph is unweighted)
assign: graph_id long, node_id long, cluster_id long, weight double; one row a node (hard) or one a membership (soft)

Many graphs are one table; an undirected edge is two rows. Ids need not be contiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans.fixpoint import ranked

EPS = 1e-8
NODE, EDGE, ASSIGN = ("graph_id", "node_id", "x"), ("graph_id", "src", "dst", "weight"), ("graph_id", "node_id", "cluster_id", "weight")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def __post_init__(self) -> None:
        check(self.nodes, NODE, "nodes")
        check(self.edges, EDGE, "edges")


def check(df: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    """The table itself, if it has the columns, with ids that are integers."""
    kinds = dict(df.dtypes)
    if lost := [c for c in columns if c not in kinds]:
        raise ValueError(f"{what}: no column {', '.join(lost)}")
    if bad := [c for c in columns if c not in ("x", "weight") and kinds[c] not in ("bigint", "int")]:
        raise ValueError(f"{what}: {', '.join(bad)} must be integers")
    if "x" in columns and not kinds["x"].startswith("array<"):
        raise ValueError(f"{what}: x must be an array")
    return df


def w_or_1(col: str = "weight") -> Column:
    """An edge's weight; 1 in an unweighted graph."""
    return F.coalesce(F.col(col).cast("double"), F.lit(1.0))


def width(nodes: DataFrame) -> int:
    """Features of a node, from one row."""
    row = nodes.select(F.size("x")).first()
    return int(row[0]) if row else 0


def collated(graphs: list[Graph]) -> Graph:
    """The disjoint union; graph ids are numbered in the order given."""
    if not graphs:
        raise ValueError("no graphs")
    nodes, edges = None, None
    for k, g in enumerate(graphs):
        n, e = g.nodes.withColumn("graph_id", F.lit(k).cast("long")), g.edges.withColumn("graph_id", F.lit(k).cast("long"))
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    return Graph(nodes, edges)


def renumbered(graph: Graph) -> Graph:
    """The disjoint union of all graphs of a table in one step; graph ids are numbered from 0 in their order."""
    ids = graph.nodes.select("graph_id").distinct().withColumn("_all", F.lit(0))
    ids = ranked(ids, ["_all"], [F.col("graph_id")], "_to", spread=True).select("graph_id", "_to")
    nodes, edges = (d.join(ids, "graph_id").withColumn("graph_id", F.col("_to")).drop("_to") for d in (graph.nodes, graph.edges))
    return Graph(nodes, edges)


def separated(graph: Graph, graph_id: int) -> Graph:
    """One graph of a union."""
    return Graph(graph.nodes.where(F.col("graph_id") == graph_id), graph.edges.where(F.col("graph_id") == graph_id))
