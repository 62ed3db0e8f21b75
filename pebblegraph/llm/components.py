"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_dir


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``edges`` (u, v of one ordered type; direction is ignored).

    Each round is joins and minima over edges, never a group held in one task; it is cut with checkpoint(). Loops and
    null ends are left out, so a node without other edges is not in the result. Rounds grow with the logarithm of the
    longest chain.
    """
    work_dir(edges.sparkSession)
    here = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = _signature(here)
    for _ in range(rounds):
        if not seen[0]:
            break
        # large star: each neighbour above u, and u, points to the least of u and its neighbours
        both = here.union(here.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and each neighbour below u point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        here = small.checkpoint()
        now = _signature(here)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = here.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return here.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).join(roots.select("node"), "node", "left_anti").unionByName(roots)
