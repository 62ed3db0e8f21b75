"""A training corpus from ``documents``: quality rules, near-dedup, substring dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
``documents``; where a stage changes a text, ``n_chars`` follows it. A text that loses all its words stays, as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pebblegraph.llm import packing, quality, secret_scan, simhash, substring
from pebblegraph.llm.common import made_so_far, released, written


def _documents(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents from an operator's ``row`` and ``text``."""
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return rows.select(*(own.get(c, F.col(f"row.`{c}`").alias(c)) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the trees reject go."""
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(quality.judged(docs, trees).where("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once go."""
    return _documents(substring.without_repeats(docs), docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    found = secret_scan.scan(docs)
    return _documents(secret_scan.redacted(found, where=F.size("spans") > 0), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("substring", substring_dedup), ("secrets", secret_scans), ("packing", packed)]

#: Fingerprints, trees and token ids have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written before the next one reads it, and then what went before is deleted."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), made_so_far()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        released(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
