"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts exactly there.
WORD = r"[^\x20\x09-\x0D]+"


#: Scratch folders that this process has made, the oldest first.
_MADE: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one, of a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pebblegraph-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """A path, and the file system that holds it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends, or with released()."""
    made = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = _folder(spark, made)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    _MADE.append(made)
    return f"{made}/data"


def made_so_far() -> int:
    """A mark for released()."""
    return len(_MADE)


def released(spark: SparkSession, mark: int) -> None:
    """Delete the scratch folders made since the mark, but for the last one, which holds what came of the others."""
    for made in _MADE[mark:-1]:
        fs, path = _folder(spark, made)
        fs.delete(path, True)
    del _MADE[mark:-1]


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Batches of at most 8 MB between the JVM and Python, so that long texts do not fill a worker's memory.

    The session's own setting stays if it is not the default.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(key, size)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: what follows survives lost executors and does not repeat what made it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, in one aggregation."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()
    return int(n), int(size)


def with_row(rows: DataFrame, columns: str) -> T.StructType:
    """The type of the column ``row``, nulls or not, and then ``columns``."""
    return T.StructType([T.StructField("row", rows.schema["row"].dataType), *T._parse_datatype_string(columns).fields])


def renamed(docs: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Only the named columns, under names of our own, so that other columns cannot clash."""
    return docs.select(*(F.col(f"`{old}`").alias(new) for new, old in cols.items()))
