"""Iteration and ranking that hold at any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> None:
    """See to it that checkpoints go to the folder that the session names."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="pebblegraph-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; what is written there goes when the driver's JVM ends."""
    shared(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{folder}/data"


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the shared checkpoint folder, so that its lineage ends here and lost executors do no harm."""
    shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The table, written in columns to the shared checkpoint folder: a fraction of the bytes of cut(), and of a known size."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a hashed table in a task.
HASHED = 1_000_000


def hashed(few: DataFrame, *keys: str) -> DataFrame:
    """A table of one row a key (of nodes, say), made ready to be joined with a far longer one (of edges).

    A merge join sorts both, and so a task holds its share of the longer one. Where the table is beyond the limit of broadcasts
    it is hashed instead, over as many tasks as there are HASHED rows (the session's shuffle partitions, if these are more), and
    the longer one passes in a stream. Its rows are then counted, so it should be cheap to make.
    """
    spark = few.sparkSession
    if few._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return few
    tasks = few.count() // HASHED + 1
    dealt = few.repartition(tasks, *keys) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else few
    return dealt.hint("shuffle_hash")


def unioned(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return empty.limit(0) if out is None else out


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, spread: bool = False, once: dict[str, Column] | None = None) -> DataFrame:
    """Position (from 0) of each row in its group.

    once: columns that the order names and that are dear to compute. A sort computes an expression anew in each comparison,
    so they are computed once a row before it, and left out of the result.

    Groups of graph size are ranked by one window. spread: groups may be as large as the table, so rows are sorted by ranges
    over all tasks, numbered in each, and shifted by the counts of the ranges before: no task holds a group.
    """
    once = once or {}
    columns = [c for c in df.columns if c != name]
    df = df.withColumns(once) if once else df
    if not spread:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long") - 1).drop(*once)
    keys = [*(F.col(g) for g in group), *order]
    # an id is the number of its range, then 33 bits of its row there
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()).drop(*once)
    local = stored(dealt).withColumn("_part", F.shiftright("_id", 33)).withColumn("_own", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = local.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("count"), F.min("_own").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = stored(counts.select("_part", *group, (F.coalesce(F.sum("count").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    same = [local[c].eqNullSafe(shift[c]) for c in group]
    out = local.join(shift, [local["_part"] == shift["_part"], *same])
    return out.select(*(local[c] for c in columns), (F.col("_own") + F.col("_shift")).cast("long").alias(name))


def running_sums(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The sum of ``value`` over the rows before each row, in the order of a column without repeats; no task holds all rows."""
    dealt = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = dealt.groupBy("_part").agg(F.sum(value).alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    return dealt.withColumn("_own", F.coalesce(F.sum(value).over(local), F.lit(0))).join(shift, "_part").withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_own", "_base")
