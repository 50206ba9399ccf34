"""Main text of web pages by boosted trees over DOM blocks (op 3)."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.llm import boosting
from cubeweave.llm.html_tree import Page, decode

#: Pages that the trainer makes up.
TRAINING_PAGES = 900
SLICE_BYTES = 1_000_000


class Maker:
    """Makes up pages whose main text is known, in many layouts; the labels that training needs.

    Each piece of main text holds a mark that no other text has, so a block's label
    is whether its own text has the mark.
    """

    MARK = "⁂"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        parts = "an ber ci da en fo gi ha in ko la mi no or pe ri sa te un vo wé zü ñe sch tion ment lich".split()
        self.words = ["".join(self.r.choices(parts, k=self.r.choice((1, 1, 2, 2, 3)))) for _ in range(600)]

    def some(self, low: int, high: int) -> str:
        r = self.r
        ws = r.choices(self.words, k=r.randint(low, high))
        if r.random() < 0.08:
            ws = [w + r.choice(("***", "%%%", "$$$", "&amp;&amp;")) for w in ws]
        if r.random() < 0.04:
            ws = [w.upper() + "!!" for w in ws]
        k = 0
        while k + 4 < len(ws):
            k += r.randint(3, 14)
            if k < len(ws):
                ws[k] += r.choice((".", ",", ".", "?"))
        return " ".join(ws).capitalize() + r.choice((".", ".", ".", ""))

    def links(self, n: int, wrap: str = "li") -> str:
        return "".join(f"<{wrap}><a href='/{i}'>{self.some(1, 3)}</a></{wrap}>" for i in range(n))

    def attributes(self, *names: str) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        kind = r.choice(("class", "class", "id"))
        name = r.choice(names)
        if r.random() < 0.3:
            name = r.choice(("site-", "page-", "main-" if kind == "class" else "the-", "c-")) + name
        return f' {kind}="{name}"'

    def main(self) -> str:
        r, m = self.r, self.MARK
        out = []
        if r.random() < 0.85:
            out.append(f"<h1>{m}{self.some(1, 10)}</h1>")
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14))):
            x = r.random()
            text = m + self.some(1, r.choice((3, 12, 40, 90)))
            if r.random() < 0.15:
                text += f" <a href='/x'>{self.some(1, 2)}</a> " + self.some(1, 12)
            if x < 0.55:
                out.append(f"<p>{text}</p>")
            elif x < 0.68:
                out.append(f"<p><b>{text}<br>")
            elif x < 0.74:
                out.append(f"<h{r.randint(2, 4)}>{m}{self.some(1, 8)}</h3>")
            elif x < 0.82:
                out.append(f"<ul>{''.join(f'<li>{m}{self.some(1, 15)}</li>' for _ in range(r.randint(1, 6)))}</ul>")
            elif x < 0.87:
                out.append(f"<blockquote>{'<p>' * r.randint(0, 1)}{text}</blockquote>")
            elif x < 0.9:
                out.append(f"<pre>{text}</pre>")
            elif x < 0.94:
                rows = "".join(f"<tr><td>{m}{self.some(1, 4)}</td><td>{m}{self.some(1, 4)}</td></tr>" for _ in range(r.randint(1, 4)))
                out.append(f"<table>{rows}</table>")
            else:
                out.append(f"<div>{text}</div>")
        inner = [self.advert, self.related, self.share, self.notice]
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            out.insert(r.randint(0, len(out)), r.choice(inner)())
        return "\n".join(out)

    def menu(self) -> str:
        r = self.r
        n = r.randint(2, 12)
        body = f"<ul>{self.links(n)}</ul>" if r.random() < 0.8 else self.links(n, r.choice(("span", "div")))
        return f"<nav{self.attributes('nav', 'menu') * (r.random() < 0.4)}>{body}</nav>" if r.random() < 0.65 else f"<div{self.attributes('nav', 'menu', 'navbar', 'breadcrumb')}>{body}</div>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        return f"<{tag}{self.attributes('header', 'masthead', 'banner', 'topbar')}><{'p'}>{self.some(1, 12)}</p>{self.menu() if self.r.random() < 0.5 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "footer", "div"))
        text = f"&copy; {self.some(1, 3)} &middot; {self.some(2, 40)}" if self.r.random() < 0.6 else self.some(2, 30)
        more = f"<ul>{self.links(self.r.randint(1, 6))}</ul>" if self.r.random() < 0.3 else ""
        return f"<{tag}{self.attributes('footer', 'copyright', 'legal') if tag == 'div' or self.r.random() < 0.4 else ''}>{text if self.r.random() < 0.6 else '<p>' + text + '</p>'}{more}</{tag}>"

    def advert(self) -> str:
        names = ("ad", "ads", "advert", "sponsor", "promo", "advertisement")
        name = self.r.choice(names)
        return f"<{(tag := self.r.choice(('div', 'div', 'aside', 'section')))} {self.r.choice(('class', 'class', 'id'))}=\"{name}{self.r.choice(('', '', '-1', ' box'))}\">{'<p>' * self.r.randint(0, 1)}{self.some(2, 40)}</{tag}>"

    def side(self) -> str:
        tag = self.r.choice(("aside", "aside", "div"))
        x = self.r.random()
        body = f"<h3>{self.some(1, 4)}</h3><ul>{self.links(self.r.randint(1, 8))}</ul>" if x < 0.5 else f"<p>{self.some(4, 40)}</p>"
        name = self.r.choice(("sidebar", "widget", "side"))
        return f"<{tag}{f' class={name}' if tag == 'div' else self.attributes('sidebar', 'widget')}>{body}</{tag}>"

    def related(self) -> str:
        return f"<div class=\"{self.r.choice(('related', 'recommended', 'popular'))}\"><h3>{self.some(1, 4)}</h3><ul>{self.links(self.r.randint(1, 6))}</ul></div>"

    def share(self) -> str:
        return f"<div class=\"{self.r.choice(('share', 'social', 'tags', 'byline', 'meta'))}\">{self.links(self.r.randint(1, 5), 'span')} {self.some(1, 5)}</div>"

    def notice(self) -> str:
        name = self.r.choice(("cookie", "cookie-notice", "notice", "alert", "consent", "newsletter", "popup", "subscribe"))
        return f"<{(tag := self.r.choice(('div', 'div', 'section', 'aside')))} {self.r.choice(('class', 'id'))}=\"{name}\">{'<p>' * self.r.randint(0, 1)}{self.some(4, 40)}{' <a href=/ok>ok</a>' * self.r.randint(0, 1)}</{tag}>"

    def form(self) -> str:
        return f"<form action='/s'><label>{self.some(1, 5)}</label><p>{self.some(1, 12)}</p><input name=q></form>"

    def comments(self) -> str:
        item = self.r.choice(("li", "div", "article"))
        rows = "".join(f"<{item} class=\"{self.r.choice(('comment', 'reply', 'comment-body'))}\"><p>{self.some(3, 60)}</p></{item}>" for _ in range(self.r.randint(1, 6)))
        tag = self.r.choice(("section", "div", "ol" if item == "li" else "div"))
        return f"<{tag} {self.r.choice(('class', 'id'))}=\"{self.r.choice(('comments', 'comment-list', 'respond', 'discussion'))}\"><h2>{self.some(1, 3)}</h2>{rows}</{tag}>"

    def page(self) -> str:
        r = self.r
        inner = self.main()
        before = [f() for f in (self.header, self.menu, self.notice, self.advert, self.side, self.form) if r.random() < (0.7 if f == self.menu else 0.35)]
        after = [f() for f in (self.comments, self.related, self.side, self.advert, self.form, self.share, self.notice) if r.random() < 0.25]
        if r.random() < 0.8:
            after.append(self.footer())
        x = r.random()
        if x < 0.5:
            text = f"<article{self.attributes('post', 'entry', 'article') * (r.random() < 0.3)}>{inner}{self.comments() if r.random() < 0.08 else ''}</article>"
        elif x < 0.65:
            text = f"<main>{'<article>' * (y := r.randint(0, 1))}{inner}{'</article>' * y}</main>"
        elif x < 0.9:
            name = r.choice(("content", "post", "entry", "entry-content", "article-body", "story", "main-content", "post-content"))
            text = f"<div {r.choice(('class', 'id'))}=\"{name}\">{inner}</div>"
        else:
            text = f"<div>{inner}</div>"
        if r.random() < 0.3:
            text = f"<div{self.attributes('container', 'wrapper', 'page')}>{text}{self.side() if r.random() < 0.4 else ''}</div>"
        end = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html><head><title>{self.some(1, 8)}</title><style>p{{}}</style></head><body>{''.join(before)}{text}{''.join(after)}{end}"


@cache
def trained(pages: int = TRAINING_PAGES, seed: int = 11) -> boosting.Trees:
    """The trees, fitted to made-up pages; a fixed seed, so every run has the same."""
    maker = Maker(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(maker.page())
        marked = np.zeros(len(page.nodes), bool)
        for node, text in page.segments:
            marked[node.node_id] |= Maker.MARK in text
        # A block without own text is main text if any block in it is.
        for n in reversed(page.nodes[1:]):
            if marked[n.node_id] and not n.parent.own_text:
                marked[n.parent.node_id] = True
        has_text = np.array([n.text > 0 for n in page.nodes])
        xs.append(page.features()[has_text])
        ys.append(marked[has_text])
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    return boosting.fit(x, y, np.ones(len(y)))


def main_text(pages: list[str], trees: boosting.Trees) -> list[str]:
    """The main text of each page: kept segments in page order, joined by one space."""
    parsed = [Page(p) for p in pages]
    gain = trees.gain(np.concatenate([p.features() for p in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for p in parsed:
        out.append(" ".join(decode(p, gain[at : at + len(p.nodes)])))
        at += len(p.nodes)
    return out


def extract(pages: DataFrame, trees: boosting.Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page from its whole HTML.

    Boosted trees give each block element the log-odds of holding main text, from
    its tag, attribute words, depth, place among its siblings and the densities of
    its subtree; hierarchical decoding then keeps the best set of blocks in which
    no kept block lies in a dropped one.

    Returns per row ``id_col``, ``url_col``, text (character references decoded,
    white space inside a block one space, trimmed, blocks joined by one space;
    empty if there is none) and n_chars (its code points).

    A null page is an empty one and has no text.  Repeated rows give repeated
    results, an empty table an empty one; other columns are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trees or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            sources = batch.column(2)

            def done(n: int) -> pa.RecordBatch:
                texts = main_text(held, sent.value)
                own = batch.slice(start, n)
                return pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

            for i, s in enumerate(sources):
                held.append(s.as_py() or "")
                size += len(held[-1])
                if size >= SLICE_BYTES:
                    yield done(i + 1 - start)
                    start, held, size = i + 1, [], 0
            if held:
                yield done(len(sources) - start)

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, `{url_col}` {rows.schema['url'].dataType.simpleString()}, text string, n_chars bigint")
