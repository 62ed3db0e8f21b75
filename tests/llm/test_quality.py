from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers import bag, documents, empty
from pebblegraph.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text: str | None) -> tuple[int, ...]:
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [None, "", " ", "a", "a b c", "a b c a b c", "a a a a", "a b a b a", "x\nx\nx \n\n \nx", "# $ | <>", "é 🙂 　b", "a\x0bb\x0cc\rd", "l1\r\nl1\r\nl1"])
def test_base_statistics(text):
    assert tuple(quality.statistics(text)[0]) == plain_base(text)


def test_long_texts():
    r = random.Random(6)
    for n, vocabulary in ((20_000, 9), (20_000, 40), (60_000, 10**6)):
        text = " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
        assert tuple(quality.statistics(text)[0]) == plain_base(text)


def test_more_words_than_fit_three_in_an_integer():
    words = [f"{i:x}" for i in range((1 << 21) + 50)]
    text = " ".join([*words, *words[-3:], *words[7:11]])
    assert quality.statistics(text)[0][4] == 3 + 3 + 4 + 4


def test_the_query(spark, tables):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = queries.op7_quality(spark, tables).collect()
    assert len(got) == len(rows)
    for r in got:
        own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert own == plain_base(rows[r["doc_id"]])
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r["base_failed"] and r["kept"])


def test_held_out_accuracy(spark, tables):
    d = tables.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    trees = quality.train(docs, labels.where("doc_id % 2 = 0"))
    verdicts = quality.judged(docs, trees).selectExpr("row.doc_id", "score >= 0.5 AS good").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert len(verdicts) > 50
    assert sum(r["good"] == (r["quality"] == 1) for r in verdicts) >= 0.97 * len(verdicts)


def test_scores_are_monotonic():
    r = np.random.default_rng(1)
    x = r.random((600, len(quality.FEATURES)))
    signs = list(quality.FEATURES.values())
    y = (x[:, 0] - x[:, 2] + 0.6 * np.sin(9 * x[:, 3]) + r.normal(0, 0.3, 600) > 0.1).astype(float)
    trees = quality.fit(x, y, signs)
    for f, sign in enumerate(signs):
        if sign:
            for row in x[:60]:
                grid = np.tile(row, (50, 1))
                grid[:, f] = np.linspace(-0.1, 1.1, 50)
                assert (sign * np.diff(trees.margin(grid)) >= -1e-12).all(), f


def test_flat_arrays_score_as_a_walk_down_each_tree():
    r = np.random.default_rng(2)
    x = r.random((200, 4))
    trees = quality.fit(x, (x[:, 0] > x[:, 1]).astype(float), [0] * 4, trees=7)

    def walk(row):
        total = trees.start
        for k in trees.roots:
            while trees.left[k] != k:
                k = trees.left[k] if row[trees.feature[k]] <= trees.limit[k] else trees.right[k]
            total += trees.value[k]
        return total

    assert np.allclose(trees.margin(x), [walk(row) for row in x])
    assert ((trees.probability(x) > 0.5) == (x[:, 0] > x[:, 1])).mean() > 0.9


def test_odd_rows(spark):
    docs = documents(spark)
    r = random.Random(1)
    labels = spark.createDataFrame([(i, r.randint(0, 1), "x") for i in range(1, 19)] + [(3, 1, "x"), (None, 1, None), (4, None, "y"), (999, 1, "z")], "doc_id long, quality int, text string")
    trees = quality.train(docs, labels)
    got = quality.judged(docs, trees)
    assert bag(got.select("row.doc_id", "text", "row.kept", "row.score", "row.n_words").collect()) == bag(docs.select("doc_id", "text", "kept", "score", "n_words").collect())
    assert all(x["base_failed"] for x in got.where("text is null").collect())
    for none in (labels.where("quality = 1"), labels.where("false"), labels.where("doc_id > 900")):
        assert quality.train(docs, none) is None
    assert quality.judged(docs, None).where("kept = base_failed").isEmpty()
    assert quality.judged(empty(spark), trees).count() == 0 and quality.train(empty(spark), labels) is None
    assert quality.judged(spark.range(2).selectExpr("string(id) AS text"), None).count() == 2
