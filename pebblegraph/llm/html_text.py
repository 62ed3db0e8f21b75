"""Main text of web pages by a tree-structured conditional random field.

Each element that can stand for a part of the page is a variable: content or not. Its potential comes from its tag, the words
of its class and id, and the length, links and punctuation of its text; a potential for each parent and child ties the
two. A page is a tree, so one sweep up and one down (sum-product) gives each element's marginal exactly. The weights are
fitted by the gradient of the conditional likelihood, which needs just those marginals, to ``labelled_pages``: generated
pages of many layouts, as many as a parameter says, whose parts are known.

Text of elements with a marginal of one half or more is kept. Character references are decoded, white space inside a block
is one space, blocks are joined by a line's end in page order; a line break inside a block is white space.

Nulls: a null page is an empty one, whose text is empty, as is that of a page without content. Broken markup is closed as
browsers do for paragraphs, items and cells. Repeated rows stay; tables without rows give none; other columns are not read.
Pages of any length are read whole; depth costs no recursion.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style head title noscript template svg math iframe object canvas audio video select option textarea button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
#: A start tag ends the open elements of its set, within the nearest element of the second set.
ENDS = {"p": ({"p"}, set()), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SCOPE = frozenset("article main section aside nav header footer div body table td th blockquote form figure li ul ol".split())

#: Words of class and id, by what they tell.
HINTS = {
    "content": "article articles content post entry story main maincontent text body prose page single blogpost",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar pagination pager skip toc tabs",
    "header": "header masthead branding logo site hero topnav",
    "footer": "footer foot bottom copyright colophon legal imprint",
    "side": "sidebar side aside related recommended widget widgets promo more trending popular teaser rail",
    "advert": "ad ads advert adverts advertisement adsense banner sponsor sponsored sponsors dfp",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup paywall disclaimer",
    "comment": "comment comments reply replies respond disqus discussion thread reader feedback",
    "share": "share sharing social follow tags tag meta",
    "form": "form search login field input contact",
}
HINT_OF = {w: kind for kind, words in HINTS.items() for w in words.split()}
TAGS = {t: t for t in "article main section aside nav header footer form p h1 h2 h3 ul ol li table td blockquote pre figure figcaption div body html a dl dd dt address".split()} | {"h4": "h3", "h5": "h3", "h6": "h3", "th": "td", "fieldset": "form", "menu": "nav", "dialog": "aside", "center": "div"}


class Node:
    __slots__ = ("tag", "parent", "hints", "chars", "linked", "stops", "hidden")

    def __init__(self, tag: str, parent: int, hints: tuple, hidden: bool) -> None:
        self.tag, self.parent, self.hints, self.hidden = tag, parent, hints, hidden
        self.chars = self.linked = self.stops = 0


class Page(HTMLParser):
    """Elements in page order (a parent comes before its children) and pieces of text: (element, text) or None between blocks."""

    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, (), False)]
        self.pieces: list[tuple[int, str] | None] = []
        self.open: list[tuple[str, int]] = []  # tag, element it stands for
        self.dropped = self.links = 0
        self.feed(html or "")
        self.close()
        for n in reversed(self.nodes[1:]):
            up = self.nodes[n.parent]
            up.chars, up.linked, up.stops = up.chars + n.chars, up.linked + n.linked, up.stops + n.stops

    def _here(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _pop(self, to: int) -> None:
        for tag, _ in self.open[to:]:
            self.dropped -= tag in DROPPED
            self.links -= tag == "a"
        del self.open[to:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html" or self.dropped and tag not in ("body",):
            if tag != "html" and tag not in VOID and tag in DROPPED and tag != "head":
                self.open.append((tag, self._here()))
                self.dropped += 1
            return
        if tag == "body" and self.dropped:
            self._pop(0)
        inline = tag in INLINE
        if not inline:
            ends, within = ENDS.get(tag, ({"p"} if tag not in DROPPED else set(), set()))
            stop = within or SCOPE
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in ends:
                    self._pop(k)
                    break
                if self.open[k][0] in stop:
                    break
            self.pieces.append(None)
        if tag in VOID:
            if inline:
                self.pieces.append((self._here(), " "))
            return
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")) if attrs else ""
        here = self._here()
        if tag not in DROPPED and (not inline or named):
            hints = tuple(sorted({HINT_OF[w] for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()) if w in HINT_OF})) if named else ()
            hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs)
            if not inline or hints or hidden:
                self.nodes.append(Node(tag, here, hints, hidden))
                here = len(self.nodes) - 1
        self.open.append((tag, here))
        self.dropped += tag in DROPPED
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        inline = tag in INLINE
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                break
            if inline and self.open[k][0] not in INLINE:
                return
        if not inline and not self.dropped:
            self.pieces.append(None)

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        here = self._here()
        self.pieces.append((here, data))
        n = self.nodes[here]
        size = len(data)
        n.chars += size
        n.linked += size * (self.links > 0)
        n.stops += sum(map(data.count, ".!?,;"))

    def text(self, keep: list[bool]) -> str:
        blocks, held = [], []
        for piece in [*self.pieces, None]:
            if piece is None:
                if held and (block := " ".join("".join(held).split())):
                    blocks.append(block)
                held.clear()
            elif keep[piece[0]]:
                held.append(piece[1])
        return "\n".join(blocks)


_NAMES: dict[str, int] = {}
for _n in ["bias", *(f"tag {t}" for t in sorted(set(TAGS.values()) | {"other"})), *(f"hint {h}" for h in HINTS), "hidden", *(f"chars {b}" for b in range(8)), *(f"links {b}" for b in range(4)), *(f"stops {b}" for b in range(3))]:
    _NAMES[_n] = len(_NAMES)
_BIAS, _HIDDEN, _CHARS, _LINKS, _STOPS = (_NAMES[k] for k in ("bias", "hidden", "chars 0", "links 0", "stops 0"))


def features(n: Node) -> list[int]:
    """Features that an element has."""
    out = [_BIAS, _NAMES[f"tag {TAGS.get(n.tag, 'other')}"], _CHARS + min(7, n.chars.bit_length() // 2)]
    out += [_NAMES[f"hint {h}"] for h in n.hints]
    if n.hidden:
        out.append(_HIDDEN)
    if n.chars:
        share = n.linked / n.chars
        out.append(_LINKS + (0 if share == 0 else 1 if share < 0.2 else 2 if share < 0.6 else 3))
        rate = n.stops / n.chars
        out.append(_STOPS + (0 if rate < 0.004 else 1 if rate < 0.012 else 2))
    return out


@dataclass
class Field:
    """Weights of the elements' features, and log potentials of parent (row) and child (column)."""

    weight: list[float] = field(default_factory=lambda: [0.0] * len(_NAMES))
    pair: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def marginals(self, parents: list[int], rows: list[list[int]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """P(content) of each element, and P(parent, child) of each edge (its first is empty). A parent precedes its children."""
        n, weight = len(parents), self.weight
        (e00, e01), (e10, e11) = [[math.exp(v) for v in r] for r in self.pair]
        in0, in1, up0, up1 = [1.0] * n, [0.0] * n, [1.0] * n, [1.0] * n
        for i, r in enumerate(rows):
            in1[i] = math.exp(max(-30.0, min(30.0, sum([weight[f] for f in r]))))
        for i in range(n - 1, 0, -1):  # upward: what each child says to its parent
            a, b = in0[i], in1[i]
            m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
            s = m0 + m1
            up0[i], up1[i] = m0 / s, m1 / s
            p = parents[i]
            x, y = in0[p] * up0[i], in1[p] * up1[i]
            s = x + y
            in0[p], in1[p] = x / s, y / s
        out, edges = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        s = in0[0] + in1[0]
        out[0] = in1[0] / s
        belief0, belief1 = in0, in1
        for i in range(1, n):  # downward: the parent's belief without this child's message
            p = parents[i]
            a, b = belief0[p] / up0[i], belief1[p] / up1[i]
            x, y = in0[i], in1[i]
            j00, j01, j10, j11 = a * e00 * x, a * e01 * y, b * e10 * x, b * e11 * y
            s = j00 + j01 + j10 + j11
            edges[i] = (j00 / s, j01 / s, j10 / s, j11 / s)
            d0, d1 = x * (a * e00 + b * e10), y * (a * e01 + b * e11)
            s = d0 + d1
            belief0[i], belief1[i] = d0 / s, d1 / s
            out[i] = belief1[i]
        return out, edges


def fit(pages: list[tuple[list[int], list[list[int]], list[int]]], rounds: int = 12, rate: float = 0.4, ridge: float = 1e-3) -> Field:
    """Weights by gradient ascent on the conditional likelihood. pages: parents, features and labels of the elements."""
    model = Field()
    square, square_pair = [1e-6] * len(_NAMES), [[1e-6] * 2 for _ in range(2)]
    for _ in range(rounds):
        for parents, rows, labels in pages:
            found, edges = model.marginals(parents, rows)
            slope: dict[int, float] = {}
            for r, y, p in zip(rows, labels, found):
                for f in r:
                    slope[f] = slope.get(f, 0.0) + y - p
            pair = [0.0] * 4
            for i in range(1, len(parents)):
                pair[2 * labels[parents[i]] + labels[i]] += 1.0
                for k in range(4):
                    pair[k] -= edges[i][k]
            for f, g in slope.items():
                g -= ridge * model.weight[f]
                square[f] += g * g
                model.weight[f] += rate * g / math.sqrt(square[f])
            for k, g in enumerate(pair):
                a, b = divmod(k, 2)
                square_pair[a][b] += g * g
                model.pair[a][b] = max(-8.0, min(8.0, model.pair[a][b] + rate * g / math.sqrt(square_pair[a][b])))
    return model


MARKED = "\x02"


def labelled_pages(count: int = 300, seed: int = 7) -> Iterator[str]:
    """Generated pages; the text of each part of the article has ``MARKED`` in it."""
    r = random.Random(seed)
    pick, word = r.choice, lambda: "".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 9)))

    def words(lo: int, hi: int, stop: str = ".") -> str:
        out = [word() + ("," if r.random() < 0.08 else "") + (". " if r.random() < 0.07 else "") for _ in range(r.randint(lo, hi))]
        return " ".join(out).capitalize() + stop

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3, "")}</a></li>' for _ in range(n))

    def named(kind: str, rate: float = 1.0) -> str:
        return f' {pick(["class", "id"])}="{pick(["", word() + "-"])}{pick(HINTS[kind].split())}"' if r.random() < rate else ""

    def text(lo: int, hi: int, stop: str = ".") -> str:
        out = words(lo, hi, stop)
        if r.random() < 0.2:
            out = out.replace(" ", f' <a href="/{word()}">{words(1, 3, "")}</a> ', 1)
        return pick(["", "", "<b>", "<em>"]) + MARKED + out

    def article() -> str:
        out = [f"<h1>{text(2, 12, '')}</h1>"] if r.random() < 0.8 else []
        for _ in range(pick([1, 2, 3, 5, 9, 14])):
            kind = r.random()
            if kind < 0.66:
                out.append(f"<p>{text(2, 90)}</p>" if r.random() < 0.9 else f"<p>{text(5, 60)}<br>")
            elif kind < 0.76:
                out.append(f"<h{pick('234')}>{text(1, 8, '')}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{text(2, 20)}" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{text(5, 40)}</p></blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{text(1, 3, '')}<td>{text(1, 3, '')}" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><figcaption>{text(3, 12)}</figcaption></figure>")
            elif kind < 0.96:
                out.append(f"<pre>{text(3, 30)}</pre>")
            else:
                out.append(other(pick(["advert", "side", "share", "notice"])))
        if r.random() < 0.25:
            out.insert(0, f"<div>{text(4, 20)}</div>")
        body = "".join(out)
        return pick([f"<article{named('content', .4)}>{body}</article>", f"<main{named('content', .3)}>{body}</main>", f"<main><article>{body}</article></main>", f"<div{named('content')}>{body}</div>", f"<section{named('content')}>{body}</section>", f"<div{named('content')}><div>{body}</div></div>"])

    def comments() -> str:
        one = lambda: pick([f"<li{named('comment', .5)}><p>{words(3, 60)}</p></li>", f"<div{named('comment', .7)}><b>{words(1, 2, '')}</b><p>{words(3, 80)}</p><p>{words(3, 40)}</p></div>", f"<article{named('comment')}><p>{words(4, 60)}</p></article>"])
        return f"<{(t := pick(['section', 'div', 'aside', 'ol', 'div']))}{named('comment')}><h3>{words(1, 3, '')}</h3>{''.join(one() for _ in range(r.randint(1, 6)))}</{t}>"

    def other(kind: str) -> str:
        if kind == "menu":
            t = pick(["nav", "nav", "div", "ul"])
            return f"<{t}{named('menu', .5 if t == 'nav' else 1)}>" + (links(r.randint(2, 9)) if t == "ul" else f"<ul>{links(r.randint(2, 9))}</ul>") + f"</{t}>"
        if kind == "header":
            t = pick(["header", "div"])
            return f"<{t}{named('header', .5 if t == 'header' else 1)}>{pick(['<h1>', '<a href=/>', '<p>', ''])}{words(1, 6, '')}{pick(['', other('menu')])}</{t}>"
        if kind == "footer":
            t = pick(["footer", "footer", "div"])
            return f"<{t}{named('footer', .4 if t == 'footer' else 1)}>{pick(['&copy; ', ''])}{pick(['', '<p>'])}{words(2, 30)}{pick(['', f'<ul>{links(4)}</ul>'])}</{t}>"
        if kind == "side":
            t = pick(["aside", "aside", "div", "section"])
            return f"<{t}{named('side', .5 if t == 'aside' else 1)}><h3>{words(1, 4, '')}</h3>{pick([f'<ul>{links(5)}</ul>', f'<p>{words(4, 50)}</p>', f'<div><p>{words(4, 40)}</p><a href=/>{words(1, 4)}</a></div>'])}</{t}>"
        if kind == "form":
            return f"<form{named('form', .5)}><label>{words(1, 5, '')}</label><input name=q><p>{words(2, 25)}</p><button>{word()}</button></form>"
        if kind == "comment":
            return comments()
        t = pick(["div", "div", "section", "p", "aside", "span"])
        inner = words(2, 40)
        return f"<{t}{named(kind)}>{inner if t in ('p', 'span') else pick([inner, f'<p>{inner}</p>', f'<p>{inner}</p><a href=/>{words(1, 3)}</a>'])}</{t}>"

    for _ in range(count):
        if r.random() < 0.12:  # a piece of a page without its frame
            yield pick([article, lambda: f"<article><p>{text(2, 8)}</p>{pick(['', other('form')])}</article>", lambda: text(3, 40), lambda: f"<p>{text(3, 40)}</p>"])()
            continue
        before = "".join(other(k) for k in ("notice", "header", "menu", "advert", "form", "side") if r.random() < 0.5)
        after = "".join(other(k) for k in ("share", "comment", "side", "advert", "form", "comment", "notice", "footer") if r.random() < 0.5)
        inner = before + article() + after
        if r.random() < 0.3:
            inner = f"<div{pick(['', ' id=wrapper', ' class=container'])}>{inner}</div>"
        yield f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{inner}{pick(['', '</body></html>'])}"


def training_rows(html: str) -> tuple[list[int], list[list[int]], list[int]]:
    """Parents, features and labels of a labelled page's elements: an element is content if a marked text is inside."""
    page = Page(html)
    labels = [0] * len(page.nodes)
    for piece in page.pieces:
        if piece and MARKED in piece[1]:
            labels[piece[0]] = 1
    for i in range(len(labels) - 1, 0, -1):
        labels[page.nodes[i].parent] |= labels[i]
    return [n.parent for n in page.nodes], [features(n) for n in page.nodes], labels


_FITTED: dict[tuple[int, int], Field] = {}


def trained(count: int = 300, seed: int = 7) -> Field:
    """The field fitted to ``count`` generated pages."""
    if (count, seed) not in _FITTED:
        _FITTED[count, seed] = fit([training_rows(p) for p in labelled_pages(count, seed)])
    return _FITTED[count, seed]


def main_text(html: str | None, model: Field) -> str:
    page = Page(html)
    found, _ = model.marginals([n.parent for n in page.nodes], [features(n) for n in page.nodes])
    return page.text([p >= 0.5 for p in found])


def extract(pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, sent.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
