"""Shards of bounded size by extendible hashing. JVM expressions only.

A row's key is 60 bits of the MD5 of its id and text. A bucket is a prefix of the key; it splits on one more bit as long as
it holds more than ``limit`` bytes, so the directory is deep only where the bytes are. A bucket's bytes never exceed those of
its parent, so a row's shard is the shortest prefix of its key whose bucket fits: sums for all depths of a range come from
one aggregation over fine buckets (a few dozen for each shard), and only what is oversized at the finest one goes on.

A bucket of one key cannot split. If it is one row over the limit, that row is a shard of its own (``oversize``). If it is
many equal rows, they go to overflow pages that fit the limit, dealt out in salted runs, so that no task numbers them all.

Nulls: a null text has no bytes; null ids and texts are part of the key as empty ones. Repeated rows stay, in one shard as far
as it has room. Empty tables give no rows. Texts of any length are one row. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 60
LIMIT = 64 << 20
#: Fine buckets for each shard that the bytes would fill, as a power of two; also the depths of each later round.
STEP = 4
#: Equal rows that are numbered in one run.
RUN = 1_000_000


def _prefix(depth: int | Column) -> Column:
    return F.expr(f"shiftright(h, {BITS - depth})") if isinstance(depth, int) else F.call_function("shiftright", F.col("h"), (F.lit(BITS) - depth).cast("int"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, h (the key), n_bytes of each row; keep: and the row itself, as a struct."""
    own = F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long").alias("h"), F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long").alias("n_bytes"), *([F.struct("*").alias("row")] if keep else []))


def assigned(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, h, n_bytes, shard (the bits of its prefix, and the page of equal rows if there is one), shard_bytes, oversize.

    keep: and row, the row itself.
    """
    if limit < 1:
        raise ValueError("a shard holds a byte at least")
    rows = written(keyed(docs, id_col, text_col, keep), "keys")
    total = int(rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    low, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + STEP)
    active, parts = rows, []
    while True:
        fine = active.groupBy(_prefix(depth).alias("p")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("h"), F.max("h").alias("top"), F.count(F.lit(1)).alias("n"))
        each = fine.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(depth)))).withColumn("q", _prefix(F.col("d")))
        sums = each.groupBy("d", "q").agg(F.sum("b").alias("bytes"), F.min("h").alias("lo"), F.max("top").alias("hi"), F.sum("n").alias("n"))
        fits = sums.where((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("d", "q", "bytes", "n")
        leaf = each.drop("n").join(fits, ["d", "q"]).groupBy("p").agg(F.min(F.struct("d", "q", "bytes", "n")).alias("leaf"))
        leaf = written(fine.select("p").join(leaf, "p", "left"), "directory")
        done = leaf.where("leaf is not null").select("p", "leaf.*")
        parts.append(active.withColumn("p", _prefix(depth)).join(done, "p"))
        if depth == BITS or leaf.where("leaf is null").isEmpty():
            break
        active = active.withColumn("p", _prefix(depth)).join(leaf.where("leaf is null").select("p"), "p", "left_semi").drop("p")
        low, depth = depth + 1, min(BITS, depth + STEP)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    bits = F.when(F.col("d") == 0, F.lit("")).otherwise(F.expr("lpad(bin(q), d, '0')"))
    own = ["doc_id", "h", "n_bytes", *(["row"] if keep else [])]
    placed = every.select(*own, bits.alias("shard"), F.col("bytes").alias("shard_bytes"), ((F.col("bytes") > limit) & (F.col("n") > 1)).alias("over"))
    fit = placed.where("not over").select(*own, "shard", "shard_bytes", (F.col("n_bytes") > limit).alias("oversize"))
    return fit.unionByName(_paged(placed.where("over"), limit, own))


def _paged(rows: DataFrame, limit: int, own: list[str]) -> DataFrame:
    """Buckets of one key that exceed the limit: pages of equal rows, one row a page if a row exceeds it."""
    run = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.greatest(F.lit(1), F.ceil(F.col("shard_bytes") / F.greatest("n_bytes", F.lit(1)) / RUN)))
    number = F.row_number().over(Window.partitionBy("h", "run").orderBy("n_bytes")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    paged = rows.withColumn("run", run).withColumn("page", F.floor(number / room))
    size = F.sum("n_bytes").over(Window.partitionBy("h", "run", "page"))
    return paged.select(*own, F.concat_ws("/", "shard", "run", "page").alias("shard"), size.alias("shard_bytes"), (F.col("n_bytes") > limit).alias("oversize"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents under ``path``, one folder a shard, or a page of equal rows."""
    rows = assigned(docs, limit, id_col, text_col, keep=True)
    rows.select("row.*", F.concat(F.lit("s"), F.translate("shard", "/", "-")).alias("_shard")).repartition("_shard").write.partitionBy("_shard").parquet(path)


def oracle(limit: int = LIMIT) -> str:
    """The same shards in DuckDB (without pages of equal rows)."""
    return f"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
e AS (SELECT rid, h, n_bytes, unnest(range(0, {BITS + 1})) AS d FROM r),
k AS (SELECT rid, d, h >> ({BITS} - d) AS q, n_bytes, h FROM e),
s AS (SELECT d, q, sum(n_bytes) AS bytes, min(h) = max(h) AS one FROM k GROUP BY d, q),
l AS (SELECT rid, min(k.d) AS d FROM k JOIN s ON k.d = s.d AND k.q = s.q WHERE bytes <= {limit} OR one GROUP BY rid)
SELECT r.doc_id, r.n_bytes, CASE WHEN l.d = 0 THEN '' ELSE lpad(bin(r.h >> ({BITS} - l.d)), CAST(l.d AS INT), '0') END AS shard, CAST(s.bytes AS BIGINT) AS shard_bytes, r.n_bytes > {limit} AS oversize
FROM r JOIN l USING (rid) JOIN s ON s.d = l.d AND s.q = r.h >> ({BITS} - l.d)"""
