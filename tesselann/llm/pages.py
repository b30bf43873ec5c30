"""Main text of web pages: boosted trees judge DOM nodes, a decoding over the tree makes their choices agree.

There are no labelled pages; the trees learn from pages drawn from a grammar of common layouts (``drawn``), in which
each part knows whether it is the article. Features are of structure, words' statistics and attribute tokens, never of
particular words of the text.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Node, read
from .shared import arrow, columns
from .trees import Boosted

#: Tags and attribute tokens that speak for and against an article.
FOR = {"article", "main", "content", "post", "entry", "story", "body", "text", "blog"}
AGAINST = {
    "nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer", "copyright", "aside", "sidebar", "widget", "related", "recommended", "notice", "cookie", "cookies", "consent", "alert", "popup",
    "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "comment", "comments", "discussion", "reply", "replies", "form", "search", "login", "subscribe", "newsletter", "share", "social", "tags", "pagination", "contentinfo", "complementary",
}
GROUPS = (FOR, {"nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination"}, {"header", "masthead", "banner"}, {"footer", "copyright", "contentinfo"}, {"aside", "sidebar", "widget", "related", "recommended", "complementary"}, {"comment", "comments", "discussion", "reply", "replies"}, {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo"}, {"notice", "cookie", "cookies", "consent", "alert", "popup"}, {"form", "search", "login", "subscribe", "newsletter", "share", "social", "tags", "button", "label"})
TAGS = ({"p", "blockquote", "pre"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"td", "th"}, {"div", "section"}, {"article", "main"}, {"button", "label", "option", "legend", "fieldset"})
#: What splitting a node's children between article and rest costs.
SPLIT = 0.5


def features(nodes: list[Node], tokens: bool = True) -> np.ndarray:
    """A row for each node; without ``tokens``, what its attributes and its ancestors' are called is left out."""
    n = len(nodes)
    size, link, words, stops, count = ([getattr(x, k) if k else 1 for x in nodes] for k in ("own", "linked", "words", "stops", ""))
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for v in (size, link, words, stops, count):
            v[p] += v[i]
    tags = [Counter(nodes[k].tag for k in x.children) for x in nodes]
    marks = [None] * n
    total = max(1, size[0])
    rows = []
    for i, x in enumerate(nodes):
        have = x.tokens | {x.tag}
        own = [bool(have & g) for g in GROUPS]
        above = marks[x.parent] if i else [0] * len(GROUPS)
        marks[i] = [a or o for a, o in zip(above, own, strict=True)]
        parent = nodes[x.parent] if i else x
        kin = parent.children if i else [0]
        same = tags[x.parent][x.tag] if i else 1
        around = max(1, size[x.parent if i else 0])
        rows.append([
            x.depth, np.log1p(x.own), np.log1p(size[i]), link[i] / max(1, size[i]), x.linked / max(1, x.own), np.log1p(words[i]), stops[i] / max(1, words[i]), size[i] / max(1, words[i]), np.log1p(count[i]), size[i] / total, x.before / total,
            len(kin), same / len(kin), size[i] / around, link[x.parent if i else 0] / around, size[i] / count[i], *(x.tag in t for t in TAGS), *([*own, *marks[i]] if tokens else ()),
        ])
    return np.array(rows, np.float64)


def decoded(nodes: list[Node], logit: np.ndarray) -> np.ndarray:
    """For each node whether its own text is article: of all assignments in which a node's whole subtree is in, is out,
    or its children are decided apart at a cost, the likeliest."""
    n = len(nodes)
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    weight = np.array([1.0 if x.own else 0.25 for x in nodes])
    all_in, all_out = (yes * weight).tolist(), (no * weight).tolist()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        all_in[p], all_out[p] = all_in[p] + all_in[i], all_out[p] + all_out[i]
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        apart = max(yes[i], no[i]) * weight[i] * bool(nodes[i].own) + sum(best[k] for k in nodes[i].children) - SPLIT
        best[i] = max(all_in[i], all_out[i], apart if nodes[i].children else -np.inf)
    state: list = [None] * n
    for i in range(n):
        above = state[nodes[i].parent] if i else None
        state[i] = above if above is not None else True if best[i] == all_in[i] else False if best[i] == all_out[i] else None
    return np.array([bool(logit[i] > 0) if s is None else s for i, s in enumerate(state)])


def words(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        w = "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiouäé") for _ in range(rng.choice((1, 1, 2, 2, 3))))
        out.append(w + rng.choice(("", "", "", "", "", "", ",", ".")))
    return " ".join(out)


def drawn(rng: random.Random) -> tuple[str, set[str]]:
    """A page, and the marks in its text that are in its article. Every block's text begins with a mark of its own."""
    marks: set[str] = set()
    number = [0]

    def text(n: int, main: bool) -> str:
        number[0] += 1
        if main:
            marks.add(f"m{number[0]}q")
        return f"m{number[0]}q {words(rng, n)}"

    def attribute(*names: str) -> str:
        return rng.choice(("", f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} c{rng.randrange(9)}"')) if names else ""

    def menu() -> str:
        items = "".join(f'<li><a href="/{k}">{text(rng.randint(1, 3), False)}</a></li>' for k in range(rng.randint(2, 9)))
        return rng.choice((f"<nav{attribute('menu', 'navbar')}><ul>{items}</ul></nav>", f'<div class="{rng.choice(("menu", "nav", "navigation"))}"><ul>{items}</ul></div>', f"<nav>{items.replace('<li>', '').replace('</li>', ' ')}</nav>"))

    def aside() -> str:
        body = "".join(rng.choice((f"<p>{text(rng.randint(2, 25), False)}</p>", f"<li><a href=#>{text(rng.randint(2, 9), False)}</a></li>", f"<h3>{text(3, False)}</h3>")) for _ in range(rng.randint(1, 5)))
        return rng.choice((f"<aside{attribute('sidebar', 'related')}>{body}</aside>", f'<div class="{rng.choice(("sidebar", "related", "widget", "recommended"))}">{body}</div>'))

    def advert() -> str:
        return f'<div class="{rng.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-box"))}">{text(rng.randint(2, 30), False)}</div>'

    def notice() -> str:
        return f'<div {rng.choice(("class", "id"))}="{rng.choice(("cookie", "cookie-consent", "notice", "alert", "popup"))}">{text(rng.randint(4, 30), False)} <button>ok</button></div>'

    def form() -> str:
        return f"<form{attribute('search', 'subscribe', 'login', 'newsletter')}><label>{text(2, False)}</label><input><button>{text(1, False)}</button>{rng.choice(('', f'<p>{text(9, False)}</p>'))}</form>"

    def comments() -> str:
        each = "".join(f'<{(t := rng.choice(("div", "li", "article")))} class="{rng.choice(("comment", "reply"))}"><p>{text(rng.randint(2, 50), False)}</p></{t}>' for _ in range(rng.randint(1, 5)))
        return f'<{(t := rng.choice(("div", "section")))} {rng.choice(("id", "class"))}="{rng.choice(("comments", "discussion"))}"><h3>{text(2, False)}</h3>{each}</{t}>'

    def article() -> str:
        parts = [rng.choice(("<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "")).format(text(rng.randint(2, 10), True))]
        for _ in range(rng.randint(1, 9)):
            long = text(rng.choice((1, 3, 8, 20, 40, 80, 120)), True)
            parts.append(rng.choice((f"<p>{long}</p>", f"<p>{long}</p>", f"<p>{long}", f"<p><b>{long}<br>", f"<p>{long} <a href=/x>{words(rng, 2)}</a> {words(rng, 5)}</p>", f"<ul><li>{long}</li><li>{text(6, True)}</li></ul>", f"<blockquote>{long}</blockquote>", f"<h2>{text(4, True)}</h2>", f"<table><tr><td>{text(2, True)}</td><td>{text(2, True)}</td></tr></table>", f"<pre>{long}</pre>", f"<div>{long}</div>")))
            if rng.random() < 0.06:
                parts.append(rng.choice((advert, form, aside))())
        body = "".join(p for p in parts if p)
        name = rng.choice(("content", "post", "entry", "story", "article-body", "main-content", "text"))
        return rng.choice((f"<article{attribute('post', 'entry')}>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f'<div class="{name}">{body}</div>', f'<div id="{name}">{body}</div>', f"<main><article>{body}</article></main>", f"<div>{body}</div>"))

    head = rng.choice(("", f"<header>{rng.choice((f'<h1>{text(3, False)}</h1>', f'<p>{text(4, False)}</p>', f'<div>{text(3, False)}</div>'))}{menu() if rng.random() < 0.5 else ''}</header>", f'<div class="{rng.choice(("header", "masthead", "banner"))}">{text(5, False)}</div>'))
    before = [f() for f in rng.sample((menu, advert, notice, aside, form, menu), rng.randint(0, 4))]
    after = [f() for f in rng.sample((comments, aside, advert, form, notice, comments), rng.randint(0, 3))]
    foot = rng.choice(("", f"<footer{attribute('footer')}>&copy; {text(rng.randint(2, 25), False)}</footer>", f"<footer><p>{text(9, False)}</p><ul><li><a href=#>{text(2, False)}</a></li></ul></footer>", f'<div class="footer">{text(12, False)}</div>'))
    inner = head + "".join(before) + article() + "".join(after)
    inner = rng.choice((inner, f'<div id="{rng.choice(("page", "wrapper", "container"))}">{inner}</div>'))
    # what was drawn and not placed leaves marks behind that no text has
    return f"<html><head><title>{words(rng, 4)}</title></head><body>{inner}{foot}</body></html>", marks


@lru_cache
def model(pages: int = 500, seed: int = 7, tokens: bool = True) -> Boosted:
    """The trees, learned from ``pages`` drawn pages."""
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        html, marks = drawn(rng)
        nodes, pieces = read(html)
        main, rest = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i, text in pieces:
            if n := len(text.strip()):
                first = text.split(maxsplit=1)[0]
                hit = first in marks if first[0] == "m" and first[-1] == "q" else None
                (main if hit or (hit is None and main[i] > rest[i]) else rest)[i] += n
        for i in range(len(nodes) - 1, 0, -1):
            main[nodes[i].parent] += main[i]
            rest[nodes[i].parent] += rest[i]
        have = main + rest > 0
        xs.append(features(nodes, tokens)[have])
        ys.append((main / np.maximum(1, main + rest))[have])
        ws.append(np.array([1.0 if x.own else 0.3 for x in nodes])[have])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def main_texts(htmls: list[str | None], trees: Boosted, tokens: bool = True) -> list[str]:
    read_ = [read(h or "") for h in htmls]
    x = [features(nodes, tokens) for nodes, _ in read_]
    logits = trees.logits(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for nodes, pieces in read_:
        chosen = decoded(nodes, logits[at : at + len(nodes)])
        at += len(nodes)
        blocks, own = [], []
        for i, text in [*pieces, (0, "")]:
            if text and chosen[i]:
                own.append(text)
            elif own and (not text or not chosen[i]):
                blocks.append(" ".join("".join(own).split()))
                own = []
        out.append("\n".join(b for b in blocks if b))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each row of ``pages``.

    Blocks are joined by a line break, white space within one is one space; a page without article, an empty or a null
    one has an empty text. Null page_id and url stay. Pages of any length are read whole. Columns other than these three
    are not read.
    """
    spark = pages.sparkSession
    told = spark.sparkContext.broadcast(model())

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for at in range(0, b.num_rows, 128):
                own = b.slice(at, 128)
                texts = main_texts(own.column(2).to_pylist(), told.value)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    arrow(spark)
    own = columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
