from __future__ import annotations

import math
import random
from html.parser import HTMLParser
from itertools import product

import pytest

from helpers import bag
from pebblegraph.llm import html_text, queries


@pytest.fixture(scope="module")
def model():
    return html_text.trained()


def test_messages_give_the_marginals_of_the_enumerated_field():
    r = random.Random(4)
    field = html_text.Field()
    field.weight = [r.uniform(-1, 1) for _ in field.weight]
    field.pair = [[r.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
    parents = [-1, 0, 0, 1, 1, 2, 5, 0]
    rows = [[r.randrange(len(field.weight)) for _ in range(4)] for _ in parents]
    mass: dict[tuple, float] = {}
    for y in product((0, 1), repeat=len(parents)):
        mass[y] = math.exp(sum(sum(field.weight[f] for f in rows[i]) for i in range(len(parents)) if y[i]) + sum(field.pair[y[parents[i]]][y[i]] for i in range(1, len(parents))))
    total = sum(mass.values())
    found, edges = field.marginals(parents, rows)
    for i in range(len(parents)):
        assert found[i] == pytest.approx(sum(m for y, m in mass.items() if y[i]) / total)
        for k, (a, b) in enumerate(product((0, 1), repeat=2)) if i else ():
            assert edges[i][k] == pytest.approx(sum(m for y, m in mass.items() if y[parents[i]] == a and y[i] == b) / total)


def test_held_out_generated_pages(model):
    right = wrong = 0
    for page in html_text.labelled_pages(60, seed=99):
        parents, rows, labels = html_text.training_rows(page)
        for p, y in zip(model.marginals(parents, rows)[0], labels):
            right += (p >= 0.5) == (y == 1)
            wrong += (p >= 0.5) != (y == 1)
    assert right / (right + wrong) > 0.97


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>A title</h1><p>First &amp; best&nbsp;text,\n with   space.</p><p>Second <b>bold</b> one.</p></article><footer>&copy; 2020</footer></body></html>", "A title\nFirst & best text, with space.\nSecond bold one."),
    ("<body><div class=ad>Buy now</div><main><p>Some words are here.<p>An open paragraph, too.</main><section class=comments><p>Nice post!</p></section></body>", "Some words are here.\nAn open paragraph, too."),
    ("<article><p>x &lt;tag&gt; &#233; &#x1F642; end.</p><script>var a = '<p>no</p>';</script><style>p{}</style><form><label>Mail</label><input></form></article>", "x <tag> é 🙂 end."),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_pages(model, html, text):
    assert html_text.main_text(html, model) == text


def test_deep_and_broken_pages(model):
    assert html_text.main_text("<div>" * 20_000, model) == ""
    assert isinstance(html_text.main_text("<p" + "<<<>>>&&&#;" * 500 + "</", model), str)
    long = "A sentence of words, and more. " * 20_000
    assert html_text.main_text(f"<article><p>{long}</p></article>", model) == long.strip()


class Article(HTMLParser):
    """Blocks of text in the article element, without what is never text, by the standard library's parser."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "u", "small"}
    HIDDEN = {"script", "style", "form", "nav", "aside", "footer", "header"}

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.inside, self.hidden, self.blocks = 0, 0, [""]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.hidden += tag in self.HIDDEN
        if tag not in self.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.hidden -= tag in self.HIDDEN
        if tag not in self.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.blocks[-1] += data

    def text(self) -> str:
        return "\n".join(b for b in (" ".join(b.split()) for b in self.blocks) if b)


def test_the_query_gives_the_article_of_every_page(spark, tables):
    tables = tables.replace("sf0.001", "sf0.01")
    want = {r["page_id"]: Article(r["html"] or "").text() for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.op2_html(spark, tables).collect()}
    assert got == want


def test_a_very_long_page_through_a_table(spark):
    long = "A sentence of words, and more. " * 30_000
    pages = spark.createDataFrame([(1, "u", f"<body><nav><a href=/>x</a></nav><article><p>{long}</p>" + "<p>One more.</p>" * 3000 + "</article></body>")], "page_id long, url string, html string")
    assert html_text.extract(pages).first()["text"] == "\n".join([long.strip(), *["One more."] * 3000])


def test_query_and_odd_rows(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    got = queries.op2_html(spark, tables).collect()
    assert bag((r["page_id"], r["url"]) for r in got) == bag(pages.select("page_id", "url").collect())
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    odd = spark.createDataFrame([(1, "u", None, "t", 0), (1, "u", None, "t", 0), (None, None, "", None, None), (2, None, "plain words, no markup.", "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    out = html_text.extract(odd)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert bag(out.where("page_id is null or page_id = 1").collect()) == bag([(1, "u", "", 0)] * 2 + [(None, None, "", 0)])
    assert html_text.extract(odd.where("false")).count() == 0
