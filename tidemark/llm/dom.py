"""A small forgiving HTML reader: block nodes with their texts in page order, and the features of each node."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from html import unescape

import numpy as np

# How HTML elements behave, and words that page templates put in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())  # no markup inside; without an end tag they run to the end
HEAD = frozenset("title base basefont bgsound link meta noframes style script noscript template".split())  # all that may stand in a head
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var br wbr math mi mo mn ms mtext mrow msup msub mfrac msqrt".split())
FOREIGN = ("svg", "math")  # the only elements that may close themselves, with those inside them
INSETS = frozenset("math svg canvas object select noscript template audio video".split())  # stand in a line, yet are nodes of their own
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"p": frozenset("article aside blockquote body div footer form header main nav section table td th li figure".split()), "li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"])}
TAG_GROUPS = ("p", "h1 h2", "h3 h4 h5 h6", "li", "ul ol menu dl", "div section", "article main", "nav menu", "header", "footer", "aside", "form fieldset button label select option optgroup datalist", "table tr td th tbody", "blockquote pre figure figcaption", "dialog", "noscript template", "svg math canvas object audio video")
TOKEN_GROUPS = {
    "menu": "nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs tabs toc pager pagination skip",
    "frame": "header head masthead top topbar footer foot bottom copyright legal logo site colophon",
    "side": "sidebar side aside widget rail related recommended popular trending more tags tag archive links column",
    "ads": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion commercial dfp taboola outbrain",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay message toast disclaimer paywall notification announcement",
    "form": "form search login signin signup register subscribe subscription newsletter contact input",
    "social": "share sharing social follow like tweet facebook twitter buttons toolbar tools",
    "comment": "comment comments comentarios kommentare commentaires reply replies respond response responses discussion disqus thread feedback reviews review",
    "content": "article content main post story entry body text page hentry prose blog news single",
    "hidden": "hidden none invisible offscreen sr",
}
_TOKEN_GROUP = {w: i for i, words in enumerate(TOKEN_GROUPS.values()) for w in words.split()}
_TAG_GROUP = {w: i for i, words in enumerate(TAG_GROUPS) for w in words.split()}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_UNQUOTED_END = re.compile(r"""=\s*[^\s"'][^\s]*\Z""")  # a "/" at the end of such a value belongs to it
_NONE_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
N_TAGS, N_TOKENS = len(TAG_GROUPS), len(TOKEN_GROUPS)


@dataclass
class Page:
    """Nodes in page order (0 is the root) and chunks of text, each of one node and one block."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[int] = field(default_factory=lambda: [-1])
    tokens: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    chunks: list[tuple[int, int, str, bool]] = field(default_factory=list)  # node, block, text, inside a link
    links: list[int] = field(default_factory=lambda: [0])
    tags_inside: list[int] = field(default_factory=lambda: [0])


def token_groups(attributes: str) -> int:
    """A bit for each group of template words that class, id, role and the like name; words are split at humps, - and _."""
    out = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value or name == "style":
            if name != "style" or _NONE_SHOWN.search(value):
                out |= 1 << _TOKEN_GROUP["hidden"]
            continue
        for piece in _PIECES.findall(value):
            g = _TOKEN_GROUP.get(piece.lower())
            if g is not None:
                out |= 1 << g
    return out


def parse(html: str) -> Page:
    """Reads the whole page; broken nesting, missing end tags and a cut-off end are taken as browsers do, roughly.

    A head ends at the first element that can't stand in one, "/" before ">" ends an element only in svg and math, and a
    CDATA section counts only there; elsewhere it is a comment up to the first ">".  Its work grows with the page, however deep its nesting.
    """
    page = Page()
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # of each open tag in the stack
    node, block, at, link, n, in_head = 0, 0, 0, 0, len(html), False

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            page.chunks.append((node, block, raw, link > 0))
        elif raw and page.chunks and page.chunks[-1][1] == block:
            page.chunks.append((node, block, " ", False))

    def close_to(k: int) -> None:
        nonlocal node, block, link
        for tag, _ in stack[k:]:
            places[tag].pop()
            link -= tag == "a"
            if tag not in INLINE and tag not in INSETS:
                block += 1
        del stack[k:]
        node = stack[-1][1] if stack else 0

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close_last(tags: Iterable[str], scope: Iterable[str]) -> None:
        """Closes the last open one of the tags, unless an element of the scope was opened after it."""
        k = last(tags)
        if k >= 0 and k > last(scope):
            close_to(k)

    def foreign() -> bool:
        return any(places.get(t) for t in FOREIGN)

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                if foreign():
                    text(m[0][9:].removesuffix("]]>"))
                else:  # a comment up to the first ">"
                    at = (html.find(">", m.start()) + 1) or n
            continue
        tag, closing = name.lower(), (m[1] if m[2] else m[4]) == "/"
        attributes = (m[3] if m[2] else m[6]) or ""
        if tag == "head":
            in_head = not closing
            continue
        if closing:
            if places.get(tag):
                close_to(places[tag][-1])
            continue
        in_head = in_head and tag in HEAD
        inside = foreign()
        self_closed = attributes.endswith("/") and (inside or tag in FOREIGN) and not _UNQUOTED_END.search(attributes)
        if tag in RAW and not (inside and (self_closed or tag == "title")):
            end = _END[tag].search(html, at)
            at = max(end.end(), at) if end else n
            continue
        if in_head and tag in VOID:
            continue
        if tag in ENDS_P:
            close_last(("p",), SCOPES["p"])
        elif tag in SAME_ENDS:
            close_last(SAME_ENDS[tag], SCOPES.get(tag, ()))
        if tag not in INLINE and tag not in INSETS:
            block += 1
        if tag in VOID or self_closed:
            page.tags_inside[node] += 1
            if tag in ("br", "wbr"):
                text(" ")
            continue
        groups = token_groups(attributes) if attributes else 0
        page.tags_inside[node] += 1
        if tag == "a":
            link += 1
            page.links[node] += 1
        if tag not in INLINE or tag in INSETS or groups:
            page.parent.append(node)
            page.tag.append(_TAG_GROUP.get(tag, -1))
            page.tokens.append(groups)
            page.depth.append(len(stack) + 1)
            page.links.append(0)
            page.tags_inside.append(0)
            node = len(page.parent) - 1
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))
    return page


FEATURES = 2 * N_TAGS + 2 * N_TOKENS + 17


def features(page: Page) -> np.ndarray:
    """(nodes, FEATURES): tag and attribute tokens of the node and its ancestors, sizes and densities of its own text and subtree, depth, siblings and place."""
    n = len(page.parent)
    parent = np.array(page.parent)
    x = np.zeros((n, FEATURES), np.float32)
    own, own_link, commas, stops, words, capital = (np.zeros(n) for _ in range(6))
    for node, _, text, link in page.chunks:
        size = len(text)
        own[node] += size
        if link:
            own_link[node] += size
        commas[node] += text.count(",")
        stops[node] += text.count(". ") + text.endswith((".", "!", "?"))
        words[node] += text.count(" ") + 1
    tag, tokens = np.array(page.tag), np.array(page.tokens)
    x[np.flatnonzero(tag >= 0), tag[tag >= 0]] = 1
    a = N_TAGS
    for g in range(N_TOKENS):
        x[:, a + g] = (tokens >> g) & 1
    b = a + N_TOKENS
    up_tag, up_tok = np.zeros((n, N_TAGS), bool), np.zeros((n, N_TOKENS), bool)
    kids, index = np.zeros(n), np.zeros(n)
    for i in range(1, n):
        p = page.parent[i]
        up_tag[i] = up_tag[p] | (x[p, :N_TAGS] > 0)
        up_tok[i] = up_tok[p] | (x[p, a : a + N_TOKENS] > 0)
        index[i] = kids[p]
        kids[p] += 1
    x[:, b : b + N_TAGS] = up_tag
    c = b + N_TAGS
    x[:, c : c + N_TOKENS] = up_tok
    sub, sub_link, sub_tags, sub_stop, sub_words, sub_p = own.copy(), own_link.copy(), np.array(page.tags_inside, float), stops.copy(), words.copy(), (tag == 0).astype(float)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        for v in (sub, sub_link, sub_tags, sub_stop, sub_words, sub_p):
            v[p] += v[i]
    before = np.concatenate(([0], np.cumsum(own)[:-1]))
    total = max(own.sum(), 1)
    up = np.maximum(parent, 0)
    d = c + N_TOKENS
    cols = (
        np.log1p(own), own_link / np.maximum(own, 1), commas / np.maximum(words, 1), stops, words / np.maximum(stops, 1),
        np.log1p(sub), sub_link / np.maximum(sub, 1), sub_tags / np.maximum(sub_words, 1), sub_stop / np.maximum(sub_words, 1), np.log1p(sub_p),
        sub / total, before / total, np.array(page.depth, float), np.log1p(kids), kids[up], index / np.maximum(kids[up], 1), sub[up] / total,
    )
    for k, v in enumerate(cols):
        x[:, d + k] = v
    return x


def chosen_text(page: Page, keep: np.ndarray) -> str:
    """The blocks of kept nodes: character references decoded, white space runs one space, joined by newlines."""
    out: list[str] = []
    block, parts = -1, []
    for node, b, raw, _ in [*page.chunks, (-1, -2, "", False)]:
        if b != block:
            if line := " ".join("".join(parts).split()):
                out.append(line)
            block, parts = b, []
        if node >= 0 and keep[node]:
            parts.append(unescape(raw) if "&" in raw else raw)
    return "\n".join(out)


def decode(page: Page, p: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the best labelling in which nothing below a dropped node is kept.

    A node weighs its own text; dropping it drops its subtree.  Solved from the leaves up, then read from the root down.
    """
    n = len(page.parent)
    weight = np.full(n, 4.0)
    for node, _, text, _ in page.chunks:
        weight[node] += len(text)
    q = np.clip(p, 0.01, 0.99)
    kept, dropped = weight * np.log(q), weight * np.log(1 - q)
    best = kept.copy()
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        dropped[up] += dropped[i]
        best[up] += max(best[i], dropped[i])
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and best[i] >= dropped[i]
    return keep
