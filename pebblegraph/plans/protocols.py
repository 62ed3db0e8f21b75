"""What the four steps look like to those who bring their own."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from ..graph import Graph


class Select(Protocol):
    """Nodes to supernodes: an assign table."""

    def __call__(self, g: Graph) -> DataFrame: ...


class Reduce(Protocol):
    """Features of supernodes: a nodes table."""

    def __call__(self, nodes: DataFrame, assign: DataFrame) -> DataFrame: ...


class Connect(Protocol):
    """Edges between supernodes."""

    def __call__(self, edges: DataFrame, assign: DataFrame) -> DataFrame: ...


class Lift(Protocol):
    """Supernode features back on the nodes."""

    def __call__(self, pooled: DataFrame, assign: DataFrame, nodes: DataFrame) -> DataFrame: ...


def composed(g: Graph, select: Select, reduce: Reduce, connect: Connect) -> tuple[Graph, DataFrame]:
    """The pooled graph and its assignment, from three steps of the caller's own."""
    assign = select(g)
    return Graph(reduce(g.nodes, assign), connect(g.edges, assign)), assign
