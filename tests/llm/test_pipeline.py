from __future__ import annotations

import pytest

import corpus_pipeline
from helpers import bag, documents, empty
from pebblegraph.llm import quality, secret_scan, simhash
from test_secret_scan import base_spans
from test_simhash import plain_fingerprint, plain_groups
from test_substring import plain


@pytest.fixture(scope="module")
def stages(spark, tables):
    """Each stage's input and output over the table."""
    out, docs = {}, spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, tables).cache()
        out[name] = docs, got
        docs = got
    return out


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring", "secrets", "packing"]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for name in list(stages)[:-1]:
        docs, got = stages[name]
        assert got.columns == docs.columns and got.dtypes == docs.dtypes


def test_quality_drops_what_the_rules_reject(stages, spark, tables):
    docs, got = stages["quality"]
    kept = {r["doc_id"] for r in got.collect()}
    assert 0 < len(kept) < docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    for r in docs.collect():
        base = quality.statistics(r["text"])[0]
        if quality.base_failed(base[0], base[4]):
            assert r["doc_id"] not in kept
        elif labels.get(r["doc_id"]) == 1:
            assert r["doc_id"] in kept


def test_near_dedup_keeps_the_first_of_each_group(stages):
    docs, got = stages["near_dedup"]
    groups = plain_groups({r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()})
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(groups.values()))


def test_substring_removes_repeated_windows(stages):
    docs, got = stages["substring"]
    rows = docs.collect()
    after = {r["doc_id"]: r for r in got.collect()}
    for r, (w, gone) in zip(rows, plain([r["text"] for r in rows], 35)):
        want = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else r["text"]
        assert after[r["doc_id"]]["text"] == want and after[r["doc_id"]]["n_chars"] == len(want)


def test_secrets_are_gone(stages):
    docs, got = stages["secrets"]
    assert docs.count() == got.count()
    assert all(not [s for s in base_spans(r["text"]) if secret_scan.MARK not in r["text"][s[0] : s[3]]] for r in got.collect())


def test_packing_holds_every_document(stages):
    docs, got = stages["packing"]
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in got.collect()}


def test_run_gives_the_last_stage(stages, spark, tables):
    got = corpus_pipeline.run(spark, tables)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    want = stages["packing"][1]
    whole = lambda df: sorted((r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert whole(got) == whole(want)
    assert sum(key(r)[2] for r in got.collect()) == sum(key(r)[2] for r in want.collect())


def test_odd_rows_pass_through_each_stage(spark, tables):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, tables)
        assert got.columns == docs.columns, name
        assert got.count() <= docs.count()
        if name in ("substring", "secrets"):
            assert got.count() == docs.count()
        assert stage(spark, empty(spark), tables).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty(spark), tables).count() == 0
    assert simhash.deduplicated(docs).count() < docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    ends = pieces.where("start + length = doc_tokens")
    assert ends.count() == docs.count() and bag(ends.select("doc_id").collect()) == bag(docs.select("doc_id").collect())
