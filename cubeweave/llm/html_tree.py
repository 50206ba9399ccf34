"""A small HTML reader: block elements, their text segments and features of each block."""

from __future__ import annotations

import html
import re

import numpy as np

#: Element names by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes xmp textarea title svg math select button object audio video canvas".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li", "legend"}
#: A start tag of the first closes an open element of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: Words in class, id and role, by what they tell of an element.
TOKENS = {
    "menu": ("nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip"),
    "frame": ("header", "masthead", "banner", "footer", "topbar", "bottom", "copyright", "legal", "contentinfo", "site", "colophon", "branding", "logo"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "complementary", "rail", "tags", "meta", "byline", "author"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adbox", "teaser", "outbrain", "taboola"),
    "notice": ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr", "newsletter", "subscribe", "signup", "paywall", "login", "search", "form"),
    "talk": ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "reviews", "social", "share", "sharing", "reader", "readers", "feedback"),
    "text": ("article", "content", "entry", "post", "main", "story", "body", "text", "prose", "page", "single", "articlebody", "maincontent", "blogpost", "hentry"),
}
_GROUP_OF = {w: [k for k, ws in enumerate(TOKENS.values()) if w in ws] for ws in TOKENS.values() for w in ws}
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)>|<[!?/][^>]*>", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

ROLES = (
    "p", "div", "section", "article", "main", "body", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "h3", "blockquote",
    "pre", "table", "td", "figure", "dl", "other",
)
_ROLE = {r: k for k, r in enumerate(ROLES)} | {"h4": ROLES.index("h3"), "h5": ROLES.index("h3"), "h6": ROLES.index("h3"), "th": ROLES.index("td"), "tr": ROLES.index("table"), "tbody": ROLES.index("table"), "thead": ROLES.index("table"), "figcaption": ROLES.index("figure"), "menu": ROLES.index("ul"), "dd": ROLES.index("dl"), "dt": ROLES.index("dl"), "fieldset": ROLES.index("form"), "dialog": ROLES.index("aside"), "html": ROLES.index("body")}

FEATURES = (
    [f"tag_{r}" for r in ROLES] + [f"own_{t}" for t in TOKENS] + [f"above_{t}" for t in TOKENS]
    + ["in_nav", "in_header", "in_footer", "in_aside", "in_form", "in_article", "in_main", "in_list", "hidden", "depth", "index", "siblings", "same_tag", "from_end",
       "text", "words", "link_share", "tags_per_char", "word_length", "stops", "own_text", "paragraphs", "links", "page_share", "page_place", "parent_link_share", "parent_text", "before_link_share", "after_link_share", "copyright"]
)


class Node:
    """A block element."""

    __slots__ = ("tag", "parent", "children", "own", "above", "hidden", "depth", "text", "words", "links", "link_text", "tags", "stops", "own_text", "paragraphs", "place", "copyright", "inside", "node_id", "index")

    def __init__(self, tag: str, parent: Node | None, attributes: str, node_id: int) -> None:
        self.tag, self.parent, self.children, self.node_id = tag, parent, [], node_id
        self.own = [0] * len(TOKENS)
        self.hidden = bool(parent and parent.hidden)
        if attributes:
            for name, a, b, c in _NAMED.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("hidden", "aria-hidden"):
                    self.hidden |= value != "false"
                elif name == "style":
                    self.hidden |= "display:none" in value.replace(" ", "").lower()
                else:
                    for w in _WORDS.findall(value):
                        for k in _GROUP_OF.get(w.lower(), ()):
                            self.own[k] = 1
        if parent is None:
            self.above, self.inside, self.depth, self.index = [0] * len(TOKENS), frozenset(), 0, 0
        else:
            self.above = [x | y for x, y in zip(parent.own, parent.above)]
            self.inside = parent.inside | {parent.tag} if parent.tag in _WITHIN else parent.inside
            self.depth = parent.depth + 1
            self.index = len(parent.children)
            parent.children.append(self)
        self.text = self.words = self.links = self.link_text = self.tags = self.stops = self.own_text = self.paragraphs = self.copyright = 0
        self.place = 0.0


_WITHIN = frozenset(("nav", "header", "footer", "aside", "form", "article", "main", "ul", "ol", "menu"))


class Page:
    """A page's block elements in document order, and its segments as (node, text): text that no block boundary parts."""

    def __init__(self, source: str) -> None:
        root = Node("html", None, "", 0)
        self.nodes, self.segments = [root], []
        # Open elements as (tag, the block that it is or stands in, whether it is a link).
        stack: list[tuple[str, Node]] = [("html", root)]
        piece: list[str] = []
        linked = 0
        in_link = [0]
        head = False

        def close_segment() -> None:
            nonlocal linked
            if piece:
                text = " ".join(html.unescape("".join(piece)).split())
                piece.clear()
                if text:
                    self._add(stack[-1][1], text, min(linked, len(text)))
            linked = 0

        def pop_to(index: int) -> None:
            nonlocal stack
            for tag, _ in stack[index:]:
                if tag in BLOCKS:
                    close_segment()
                if tag == "a":
                    in_link[0] = max(0, in_link[0] - 1)
            del stack[index:]

        at, skip_until = 0, None
        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at and not head:
                text = source[at : m.start()]
                piece.append(text)
                if in_link[0]:
                    linked += len(text)
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            block = stack[-1][1]
            block.tags += 1
            if closing:
                if tag == "head":
                    head = False
                    continue
                if tag == "br":
                    piece.append(" ")
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        if tag in BLOCKS or all(t not in BLOCKS for t, _ in stack[k:]):
                            if tag in BLOCKS:
                                close_segment()
                            pop_to(k)
                        break
                    if stack[k][0] in ("article", "body", "td", "th", "table") and tag not in BLOCKS:
                        break
                continue
            if tag in RAW:
                if not attributes.endswith("/") or tag in ("script", "style", "textarea", "title"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if tag == "head":
                head = True
                continue
            if head and (tag in BLOCKS or tag == "body"):
                head = False
            if head:
                continue
            if tag == "br":
                piece.append(" ")
                continue
            if tag == "img" or tag == "input" or tag in VOID and tag != "hr":
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] in ("table", "td", "th", "caption", "article", "section", "div", "main", "aside", "nav", "header", "footer", "blockquote", "li"):
                        break
            if tag in IMPLIED:
                closed, limit = IMPLIED[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closed:
                        pop_to(k)
                        if tag not in ("tr",):
                            break
                    elif stack[k][0] in limit:
                        break
            if tag == "hr":
                close_segment()
                continue
            if tag in BLOCKS:
                close_segment()
                if tag == "html" or tag == "body" and any(n.tag == "body" for n in self.nodes[1:3]):
                    continue
                node = Node(tag, stack[-1][1], attributes, len(self.nodes))
                self.nodes.append(node)
                stack.append((tag, node))
            else:
                if tag == "a":
                    in_link[0] += 1
                    stack[-1][1].links += 1
                stack.append((tag, stack[-1][1]))
        if at < len(source) and not head:
            rest = source[at:]
            # A tag that the page's end cuts off is no text.
            cut = re.search(r"<[!/a-zA-Z][^>]*\Z", rest)
            piece.append(rest[: cut.start()] if cut else rest)
        pop_to(1)
        close_segment()
        self._sum()

    def _add(self, node: Node, text: str, linked: int) -> None:
        self.segments.append((node, text))
        node.own_text += len(text)
        node.text += len(text)
        node.link_text += linked
        node.words += text.count(" ") + 1
        node.stops += text.count(". ") + text.count(", ") + (text[-1] in ".!?")
        node.copyright |= "\xa9" in text or "copyright" in text[:200].lower()

    def _sum(self) -> None:
        before = 0
        for n in self.nodes:
            n.place = before
            before += n.own_text
        for n in reversed(self.nodes):
            n.paragraphs += n.tag == "p"
            p = n.parent
            if p is not None:
                for k in ("text", "link_text", "words", "tags", "stops", "links", "paragraphs"):
                    setattr(p, k, getattr(p, k) + getattr(n, k))
                p.copyright |= n.copyright and n.own_text > 0 and len(p.children) < 4

    def features(self) -> np.ndarray:
        """A row of FEATURES for each node."""
        total = max(1, self.nodes[0].text)
        out = np.zeros((len(self.nodes), len(FEATURES)), np.float32)
        first = len(ROLES)
        for i, n in enumerate(self.nodes):
            row = out[i]
            row[_ROLE.get(n.tag, len(ROLES) - 1)] = 1
            p = n.parent
            siblings = p.children if p is not None else [n]
            k = n.index
            before = siblings[k - 1] if k > 0 else None
            after = siblings[k + 1] if k + 1 < len(siblings) else None
            share = n.link_text / max(1, n.text)
            inside = n.inside
            row[first:] = [
                *n.own, *n.above,
                "nav" in inside, "header" in inside, "footer" in inside, "aside" in inside, "form" in inside, "article" in inside, "main" in inside,
                "ul" in inside or "ol" in inside or "menu" in inside, n.hidden, n.depth, min(k, 20), min(len(siblings), 50),
                sum(s.tag == n.tag for s in siblings[:50]), min(20, len(siblings) - 1 - k),
                np.log1p(n.text), np.log1p(n.words), share, min(1, n.tags / max(1, n.text)), min(20, n.text / max(1, n.words)), min(1, n.stops / max(1, n.words)),
                np.log1p(n.own_text), min(n.paragraphs, 20), min(n.links, 30), n.text / total, n.place / total,
                p.link_text / max(1, p.text) if p else 0, np.log1p(p.text) if p else 0,
                before.link_text / max(1, before.text) if before else -1, after.link_text / max(1, after.text) if after else -1, n.copyright,
            ]
        return out


def decode(page: Page, gain: np.ndarray) -> list[str]:
    """The segments of the best choice in which no kept element lies in a dropped one.

    ``gain`` is each node's log-odds of being main text, which counts for its own
    segments.  From the leaves up, an element is kept if its own gain and that of
    what is best kept below it sum to more than nothing; dropping an element drops
    all below.
    """
    total = [float(g) if n.own_text else min(0.0, float(g)) / 2 for n, g in zip(page.nodes, gain)]
    for n in reversed(page.nodes[1:]):
        total[n.parent.node_id] += max(0.0, total[n.node_id])
    open_ = [False] * len(page.nodes)
    for i, n in enumerate(page.nodes):
        open_[i] = n.parent is None or open_[n.parent.node_id] and total[i] > 0
    return [text for n, text in page.segments if open_[n.node_id] and gain[n.node_id] > 0]
