"""Secret scans over every version of every document, with a ledger of what has been scanned. JVM expressions only.

A version's text is a blob, known by its SHA-256. The ledger is a table of (rule_version, blob, spans): one row for each blob
that those rules have seen, with or without findings. A scan keeps one row of each blob, drops the blobs that the ledger
has under the rules' version, scans the rest, appends them to the ledger, and joins findings back to all rows by blob. So a
text that thousands of paths hold is scanned once, and a later call scans new texts only. Writers of one ledger that run at the same
time, or an append that is repeated, may leave a blob there twice, with the same spans; findings are joined back once.

Places: matches and the gaps between them come from regexp_extract_all and split; one row each, a running sum of their
lengths in code points gives start and end (exclusive), in the partitions that the blobs already have.

Nulls: a null text is an empty one. Repeated rows are joined back each. Empty tables give no rows and add nothing. A text of
any length is scanned whole. Other columns are carried in the struct ``row``, so names cannot clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, and what a text must match to be looked at (a cheap test before the pattern itself).
RULES: list[tuple[str, str, str]] = [
    ("assign", ASSIGN, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    ("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
    ("login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$&*+=-]{6,}@", r"://[A-Za-z0-9._-]+:"),
]
BASE = ("assign", "access", "hex")
MARK = "[SECRET]"
SPAN = "array<struct<start: bigint, kind_no: int, kind: string, end: bigint>>"


def rule_version(rules: list[tuple[str, str, str]] = RULES) -> str:
    """Changes with the rules, so that changed rules scan everything anew."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _kept(kind: str, match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6 if kind == "assign" else F.lit(True)


def _matches(text: Column, number: int, kind: str, pattern: str, test: str) -> Column:
    """Each match in order: what precedes it since the last one, its length, whether it counts."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), _kept(kind, m).alias("counts")))
    return F.when(text.rlike(test), F.filter(pairs, lambda p: p["size"].isNotNull()))


def scanned(blobs: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """blob, spans of each row of ``blobs`` (blob, text; one row a blob)."""
    none = F.array().cast("array<struct<kind_no: int, kind: string, gap: bigint, size: bigint, counts: boolean>>")
    found = F.concat(*(F.coalesce(_matches(F.col("text"), k, *rule), none) for k, rule in enumerate(rules)))
    rows = blobs.select("blob", F.posexplode_outer(found).alias("pos", "m")).select("blob", "pos", "m.*")
    until = Window.partitionBy("blob", "kind_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(until))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "kind_no", "kind", "end")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("counts"), span))).cast(SPAN).alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None, rules: list[tuple[str, str, str]] = RULES, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns but the text), ``text``, blob, spans of every row.

    ledger: the folder of the ledger; a new one if none is given.
    """
    spark, version = docs.sparkSession, rule_version(rules)
    ledger = ledger or fresh_path(spark, "ledger")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    versions = docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(0).alias("_")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    versions = versions.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    blobs = versions.select("blob", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    seen = _ledger(docs, ledger)
    if seen is not None:
        blobs = blobs.join(seen.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    scanned(blobs, rules).withColumn("rule_version", F.lit(version)).write.mode("append").partitionBy("rule_version").parquet(ledger)
    findings = _ledger(docs, ledger).where(F.col("rule_version") == version).where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    return versions.join(findings, "blob", "left").select("row", "text", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _ledger(docs: DataFrame, path: str) -> DataFrame | None:
    """The ledger, or None where there is none yet."""
    spark = docs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(f"blob string, spans {SPAN}, rule_version string").parquet(path)


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of each span, joined by commas; only those of ``kinds`` if given."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", where: Column | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """The table with each finding in the text replaced by a mark, one kind after the other, in time linear in the text.

    where: rows that have findings, if that is known; others are left as they are.
    """
    for kind, pattern, test in rules:
        text = F.col(f"`{text_col}`")
        parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _marker(kind))
        docs = docs.withColumn(text_col, F.when(text.rlike(test) if where is None else where & text.rlike(test), F.array_join(parts, "")).otherwise(text))
    return docs


def _marker(kind: str):
    return lambda gap, m: F.when(m.isNull(), gap).when(_kept(kind, m), F.concat(gap, F.lit(MARK))).otherwise(F.concat(gap, m))


def _sql() -> str:
    """The same spans in DuckDB."""
    quoted = lambda p: p.replace("'", "''")
    parts = " UNION ALL ".join(f"SELECT rid, {k} AS kind_no, '{kind}' AS kind, regexp_extract_all(t, '{quoted(p)}') AS ms, string_split_regex(t, '{quoted(p)}') AS gaps FROM d" for k, (kind, p, _) in enumerate(RULES))
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
u AS (SELECT rid, kind_no, kind, unnest(range(1, len(ms) + 1)) AS i, ms, gaps FROM m),
e AS (SELECT rid, kind_no, kind, ms[i] AS hit, sum(length(gaps[i]) + length(ms[i])) OVER (PARTITION BY rid, kind_no ORDER BY i) AS fin FROM u),
s AS (SELECT rid, kind_no, kind, CAST(fin - length(hit) AS BIGINT) AS a, CAST(fin AS BIGINT) AS z FROM e
      WHERE kind <> 'assign' OR length(regexp_extract(hit, '{quoted(ASSIGN)}', 2)) >= 6),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, kind_no) FILTER (kind IN ({base})) AS base,
      string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, kind_no) AS spans FROM s GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


ORACLE_SQL = _sql()
