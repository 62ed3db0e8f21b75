"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_polytope, html_text, packing, piece_fst, quality, secret_scan, sharding, simhash, substring, token_files
from .common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, count = F.col("spans"), lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", *(count(k).alias(f"n_{k}") for k in secret_scan.BASE), F.sha2(secret_scan.joined(spans, secret_scan.BASE), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.without_repeats(_table(spark, sf_dir, "documents"))
    joined = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return left.select("row.doc_id", "n_words", "n_removed", F.sha2(F.when(F.col("n_removed") > 0, F.col("text")).otherwise(joined), 256).alias("kept_sha256"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.digests(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path)
    return token_files.read_tokens(spark, path)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.judged(docs.select("doc_id", "text"), trees).select("row.doc_id", *quality.BASE, "base_failed", "kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(_table(spark, sf_dir, "documents")).drop("h")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_html, op3_packing, op4_substring, op5_pieces, op6_token_files, op7_quality, op8_sharding, op9_embeddings, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan.ORACLE_SQL, "op8_sharding": sharding.oracle()}
