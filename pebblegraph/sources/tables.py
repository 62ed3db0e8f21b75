"""Graphs from relational tables. Integer-valued features, so sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.neighbours import best_dots


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _x(*cols) -> F.Column:
    return F.array(*(c.cast("double") for c in cols)).alias("x")


#: Lines of orders in a task, and in a task that counts the pairs that they make.
LINES = 125_000


def _co_occurrence(spark: SparkSession, sf_dir: str, key: str, least: int) -> DataFrame:
    """Keys that share orders. Lines are dealt once, over as many tasks as there are LINES, as each meets all of its order.

    A pair is counted in one direction, then told in both. Pairs are dealt over as many tasks as lines, whatever the session's
    shuffle partitions are, and not counted before: few meet again among LINES, and a table of those that do not is all that
    a task would hold.
    """
    tasks = table(spark, sf_dir, "lineitem").count() // LINES + 1
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(key).alias("k")).where("l_orderkey is not null and k is not null")
    orders = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("k")).alias("_ks"))
    first = orders.select("_ks", F.posexplode("_ks").alias("_i", "src"))
    pairs = first.select("src", F.explode(F.slice("_ks", F.col("_i") + 2, F.size("_ks"))).alias("dst")).repartition(tasks, "src", "dst")
    half = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")).where(F.col("weight") >= least)
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return half.select("weight", F.inline(ways)).select(F.lit(0).cast("long").alias("graph_id"), "src", "dst", "weight")


def suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers that share orders, weighted by how many."""
    n = table(spark, sf_dir, "supplier").select(F.lit(0).cast("long").alias("graph_id"), F.col("s_suppkey").alias("node_id"), _x(F.col("s_nationkey"), F.floor("s_acctbal")))
    return Graph(n, _co_occurrence(spark, sf_dir, "l_suppkey", 1))


def parts(spark: SparkSession, sf_dir: str, least: int = 1) -> Graph:
    """Parts that share orders, ``least`` of them or more."""
    n = table(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("graph_id"), F.col("p_partkey").alias("node_id"), _x(F.col("p_size"), F.floor("p_retailprice")))
    return Graph(n, _co_occurrence(spark, sf_dir, "l_partkey", least))


def transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph for each user: event types, and how often one follows the other."""
    ev = table(spark, sf_dir, "events")
    types = ev.select("event_type").distinct().withColumn("t", F.row_number().over(Window.orderBy("event_type")).cast("long") - 1)  # a handful of types
    ev = ev.join(F.broadcast(types), "event_type")
    n = ev.groupBy(F.col("user_id").alias("graph_id"), F.col("t").alias("node_id")).agg(_x(F.count(F.lit(1)), F.sum(F.col("event_id") % 2)))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = ev.select("user_id", F.lag("t").over(w).alias("src"), F.col("t").alias("dst")).where("src is not null")
    return Graph(n, e.groupBy(F.col("user_id").alias("graph_id"), "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def conversations(spark: SparkSession, sf_dir: str) -> Graph:
    """A path for each conversation, through its turns."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("node_id"), "role", "text")
    n = c.select("graph_id", "node_id", _x(F.length(F.coalesce("text", F.lit(""))), (F.col("role") == "user").cast("int")))
    w = Window.partitionBy("graph_id").orderBy("node_id")
    up = c.select("graph_id", F.lag("node_id").over(w).alias("src"), F.col("node_id").alias("dst")).where("src is not null")
    e = up.union(up.select("graph_id", F.col("dst"), F.col("src")))
    return Graph(n, e.withColumn("weight", F.lit(1.0)))


def order_cliques(spark: SparkSession, sf_dir: str) -> Graph:
    """A complete graph for each order, of its lines; lines are numbered by a total order, as their own numbers may repeat."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    n = li.select(F.col("l_orderkey").alias("graph_id"), (F.row_number().over(w).cast("long") - 1).alias("node_id"), _x(F.col("l_quantity"), F.col("l_linenumber")))
    a, b = n.select("graph_id", F.col("node_id").alias("src")), n.select("graph_id", F.col("node_id").alias("dst"))
    return Graph(n, a.join(b, "graph_id").where("src <> dst").withColumn("weight", F.lit(1.0)))


def nearest(spark: SparkSession, sf_dir: str, k: int = 5) -> Graph:
    """Embeddings of one label and their k best dot products, rounded."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("graph_id"), F.col("vec_id").alias("node_id"), F.col("embedding").alias("x"))
    return Graph(v.withColumn("x", F.col("x").cast("array<double>")), best_dots(v, k))
