"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements whose leaves are blocks of text (inline elements belong to
their block). Every node is described by its tag, the tokens of its class, id and role and of those
above it, its depth, subtree size, link and text density, and its brothers; boosted trees give the
probability that it belongs to the article. Decoding is hierarchical: of all labellings in which
nothing under a rejected node is accepted, the likeliest is taken (one bottom-up and one top-down pass), so an
ancestor and its descendants never contradict each other.

There are no labels for pages, so the trees learn from distant ones on a bounded sample of pages:
a block is main text if it stands in the page's article or main element and under nothing that names itself as
something else. Pages without these elements are not learnt from; instead each page is also learnt with its article as a
plain div and without any element around it. Copies of the sampled pages with further kinds of furniture (side bars, comments,
notices, forms, menus as plain div elements) are added, since no sample has them all.

Edge cases: a null or empty html and a page without main text give the empty text; unclosed and stray tags
are repaired as browsers do for paragraphs and list items; very deep pages are walked without
recursion; repeated rows repeat; other columns than page_id, url and html are ignored; an empty table gives
no rows. A page without any markup is one block of text.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, sample_by_hash
from .gbt import Trees

TRAIN_PAGES = 250

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<![^>]*>|<\?[^>]*>", re.S
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "button", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = (
    "html head body main article section header footer nav aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary fieldset dialog menu hgroup center"
).split()
_IS_BLOCK = frozenset(BLOCK)
#: What an opening tag closes if it is still open, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Words by which pages name their furniture, by kind.
NAMES = {
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc links",
    "frame": "header footer masthead colophon copyright legal topbar bottom",
    "side": "sidebar side aside widget related recommended popular trending tags categories",
    "talk": "comment comments reply replies discussion disqus respond thread",
    "notice": "cookie cookies consent notice notices gdpr alert popup modal newsletter subscribe overlay warning",
    "share": "share sharing social follow login signup search form",
    "story": "article content post story entry main body text page",
}
_KIND = {w: i for i, words in enumerate(NAMES.values()) for w in words.split()}
_FURNITURE = {"nav", "aside", "footer", "header", "form", "menu", "dialog", "head"}
_TAGS = {t: i for i, t in enumerate("article main section div p h1 h2 h3 ul ol li table td blockquote pre nav aside footer header form body figure #text".split())}


def _above(up: Node | None) -> int:
    """What stands above a son of *up*: kinds of names, furniture (bit 8), article or main (bit 9)."""
    return (up.above | up.kinds | (1 << 8 if up.tag in _FURNITURE else 0) | (1 << 9 if up.tag in ("article", "main") else 0)) if up else 0


class Node:
    __slots__ = ("tag", "kinds", "up", "sons", "text", "linked", "depth", "place", "chars", "link_chars", "tags", "above")

    def __init__(self, tag: str, kinds: int, up: Node | None) -> None:
        self.tag, self.kinds, self.up = tag, kinds, up
        self.sons: list[Node] = []
        self.text, self.linked = "", 0
        self.depth = up.depth + 1 if up else 0
        self.above = _above(up)
        self.place = self.chars = self.link_chars = self.tags = 0


def _kinds(rest: str) -> int:
    out = 0
    if "=" in rest:
        for m in _ATTR.finditer(rest):
            if m[1].lower() in ("class", "id", "role"):
                for w in _TOKEN.findall((m[2] or m[3] or m[4] or "").lower()):
                    if w in _KIND:
                        out |= 1 << _KIND[w]
    return out


def parse(page: str | None) -> list[Node]:
    """The page's block elements and blocks of text, each before what it holds."""
    page = page or ""
    root = Node("html", 0, None)
    nodes, here, links, linked, pieces = [root], root, 0, 0, []

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            leaf = Node("#text", 0, here)
            leaf.text, leaf.linked = text, min(linked, len(text))
            here.sons.append(leaf)
            nodes.append(leaf)
        linked = 0

    at, low = 0, None
    while True:
        m = _MARK.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            pieces.append(page[at:end])
            if links:
                linked += end - at
        if m is None:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m["close"] and not m["rest"].endswith("/"):
                low = page.lower() if low is None else low
                if len(low) != len(page):  # rare letters change length in lower case
                    found = re.compile(rf"</{re.escape(tag)}", re.I).search(page, at)
                    stop = found.start() if found else -1
                else:
                    stop = low.find(f"</{tag}", at)
                close = page.find(">", stop) if stop >= 0 else -1
                at = close + 1 if close >= 0 else len(page)
            pieces.append(" ")
        elif tag == "a":
            links = 0 if m["close"] else 1
        elif tag in ("br", "hr"):
            pieces.append(" ")
        elif tag in _IS_BLOCK:
            flush()
            links = 0
            if m["close"]:
                up = here
                while up is not None and up.tag != tag:
                    up = up.up
                if up is not None and up.up is not None:
                    here = up.up
            elif tag == "html":
                continue
            else:
                if here.tag == "p":  # a block ends an open paragraph
                    here = here.up
                elif tag in CLOSES:
                    shut, until = CLOSES[tag]
                    up = here
                    while up is not None and up.tag not in until and up.tag not in shut:
                        up = up.up
                    if up is not None and up.tag in shut:
                        here = up.up
                if tag == "body" and here.tag == "head":
                    here = here.up
                son = Node(tag, _kinds(m["rest"]), here)
                here.sons.append(son)
                nodes.append(son)
                here = son
    flush()
    _measure(nodes)
    return nodes


def _measure(nodes: list[Node]) -> None:
    """Sizes of all nodes and their places among brothers."""
    for n in nodes:
        n.place = n.chars = n.link_chars = n.tags = 0
    for n in reversed(nodes):
        if n.tag == "#text":
            n.chars, n.link_chars = len(n.text), n.linked
        n.tags += 1
        for i, s in enumerate(n.sons):
            s.place = i
        if n.up is not None:
            n.up.chars += n.chars
            n.up.link_chars += n.link_chars
            n.up.tags += n.tags


FEATURES = len(_TAGS) + 8 + 10 + 15


def _marked(nodes: list[Node]) -> bool:
    """Whether the page has an article or main element, so that text elsewhere is known to be none."""
    return any(n.tag in ("article", "main") for n in nodes)


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    out = np.zeros((len(nodes), FEATURES), dtype=np.float32)
    total = max(1, nodes[0].chars)
    wide = len(_TAGS)
    marked = _marked(nodes)
    for row, n in zip(out, nodes, strict=True):
        tag = n.up.tag if n.tag == "#text" and n.up else n.tag
        if tag in _TAGS:
            row[_TAGS[tag]] = 1
        if n.tag == "#text":
            row[_TAGS["#text"]] = 1
        own = n.kinds if n.tag != "#text" or n.up is None else n.up.kinds
        for k in range(8):
            row[wide + k] = own >> k & 1
        for k in range(10):
            row[wide + 8 + k] = n.above >> k & 1
        brothers = n.up.sons if n.up else [n]
        rest = (n.up.chars - n.chars if n.up else 0) / max(1, len(brothers) - 1)
        words = n.text.count(" ") + 1 if n.text else 0
        row[wide + 18 :] = (
            np.log1p(n.chars), n.link_chars / max(1, n.chars), n.chars / n.tags, n.chars / total, n.depth, len(n.sons), len(brothers),
            n.place / len(brothers), np.log1p(rest), words, n.text.count(".") + n.text.count(","), n.chars / max(1, n.up.chars) if n.up else 1,
            brothers[n.place - 1].chars / total if n.place else 0, brothers[n.place + 1].chars / total if n.place + 1 < len(brothers) else 0,
            marked,
        )
    return out


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """The likeliest labels under which nothing below a rejected node is accepted."""
    yes, no = np.log(np.clip(p, 1e-6, 1)), np.log(np.clip(1 - p, 1e-6, 1))
    at = {id(n): i for i, n in enumerate(nodes)}
    keep, drop = yes.copy(), no.copy()
    for i in range(len(nodes) - 1, 0, -1):
        up = at[id(nodes[i].up)]
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    out = [True] * len(nodes)  # the page itself holds whatever there is
    for i in range(1, len(nodes)):
        out[i] = bool(out[at[id(nodes[i].up)]] and keep[i] > drop[i])
    return out


def main_text(nodes: list[Node], labels: list[bool]) -> str:
    return " ".join(n.text for n, y in zip(nodes, labels, strict=True) if y and n.text)


def distant_labels(nodes: list[Node]) -> np.ndarray:
    """1 for blocks of the article and for what holds them, else 0."""
    at = {id(n): i for i, n in enumerate(nodes)}
    furniture = (1 << _KIND["story"]) - 1
    barred = np.zeros(len(nodes), dtype=bool)
    out = np.zeros(len(nodes))
    for i, n in enumerate(nodes):
        up = at[id(n.up)] if n.up else None
        barred[i] = (up is not None and barred[up]) or n.tag in _FURNITURE or bool(n.kinds & furniture)
        if n.text and n.above >> 9 & 1 and not barred[i]:
            while i is not None and not out[i]:
                out[i] = 1
                i = at[id(nodes[i].up)] if nodes[i].up else None
    return out


def _unmarked(nodes: list[Node], labels: np.ndarray, rng: np.random.Generator | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the page with its article and main elements as plain div elements, or (without *rng*) taken out.

    Text outside the article that nothing names is left out: without the element it may be either.
    """
    furniture, known, held = (1 << _KIND["story"]) - 1, [], []
    for n, y in zip(nodes, labels, strict=True):
        if n.tag in ("article", "main"):
            if rng is None and n.up is not None:
                at = n.up.sons.index(n)
                n.up.sons[at : at + 1] = n.sons
                for son in n.sons:
                    son.up = n.up
                continue
            n.tag, n.kinds = "div", (n.kinds & furniture) | (1 << _KIND["story"] if rng is not None and rng.random() < 0.5 else 0)
        n.depth, n.above = (n.up.depth + 1 if n.up else 0), _above(n.up)
        own = n.tag in _FURNITURE or n.kinds & furniture
        known.append(bool(y or own or n.above & (furniture | 1 << 8)))
        held.append(y)
    kept = [n for n in nodes if n.tag not in ("article", "main")]
    _measure(kept)
    return features(kept)[known], np.array(held)[known]


def _furnished(page: str, rng: np.random.Generator) -> str | None:
    """A copy of *page* with other furniture around and inside its article."""
    m = re.search(r"<article[^>]*>(.*)</article>", page, re.S | re.I)
    if m is None:
        return None
    words = _SPACE.split(re.sub(r"<[^>]*>", " ", m[1]))
    body = m[1] if rng.random() < 0.7 else None  # None: an article of a few words
    some = lambda n: entities.escape(" ".join(rng.choice(words, size=n)))
    links = lambda n: "".join(f'<li><a href="#">{some(int(rng.integers(1, 4)))}</a></li>' for _ in range(n))
    k = lambda *w: str(rng.choice(w))
    made = [
        f'<aside class="{k("sidebar", "widget", "related")}"><h3>{some(2)}</h3><p>{some(12)}</p><ul>{links(4)}</ul></aside>',
        f'<div class="{k("sidebar", "related-links", "side")}"><h3>{some(2)}</h3><ul>{links(5)}</ul><p>{some(9)}</p></div>',
        f'<section id="{k("comments", "discussion")}"><h2>{some(2)}</h2>' + "".join(f'<div class="{k("comment", "reply")}"><b>{some(1)}</b><p>{some(int(rng.integers(5, 40)))}</p></div>' for _ in range(3)) + "</section>",
        f'<div class="{k("comments", "comment-list", "replies")}">' + "".join(f"<p>{some(int(rng.integers(5, 40)))}</p>" for _ in range(4)) + "</div>",
        f'<div id="{k("cookie-notice", "consent", "gdpr", "notice")}"><p>{some(14)} <a href="#">{some(1)}</a></p></div>',
        f'<div class="{k("newsletter", "popup", "subscribe")}"><p>{some(10)}</p></div>',
        f'<div class="{k("ad", "ads", "advert", "banner", "promo")}"><p>{some(8)}</p></div>',
        f'<form class="{k("search", "login", "signup")}"><label>{some(2)}</label><p>{some(5)}</p></form>',
        f'<div class="{k("nav", "menu", "breadcrumbs")}"><ul>{links(5)}</ul></div>', f'<div class="{k("share", "social")}">{some(3)}</div>',
        f'<header class="{k("top", "masthead", "site-header")}"><h2>{some(3)}</h2><p>{some(6)}</p></header>',
        f'<div class="{k("footer", "copyright", "legal")}"><p>{some(12)}</p></div>', f"<p>{some(6)}</p>",
    ]
    pick = lambda n: "".join(made[i] for i in rng.choice(len(made), size=n, replace=False))
    if body is None:
        body = f"<h1>{some(3)}</h1>" + "".join(f"<p>{some(int(rng.integers(1, 9)))}</p>" for _ in range(int(rng.integers(1, 3))))
    if rng.random() < 0.15:  # a page without an article
        return f"<html><body>{''.join(made[i] for i in rng.choice(12, size=int(rng.integers(1, 4)), replace=False))}</body></html>"
    inner = [made[i] for i in rng.choice(12, size=2, replace=False)]
    tag = k("article", "main")
    extra = k("", "", "<blockquote><p>%s</p></blockquote>" % some(15), "<ul><li>%s</li><li>%s</li></ul>" % (some(9), some(8)), "<h2>%s</h2><p>%s</p>" % (some(4), some(30)), "<pre>%s</pre>" % some(12), "<table><tr><td>%s</td></tr></table>" % some(5))
    wrap = k("%s", '<div class="content">%s</div>', '<div class="wrap"><div>%s</div></div>')
    return f"<html><body>{pick(3)}{wrap % f'<{tag}>{inner[0]}{body}{extra}{inner[1]}</{tag}>'}{pick(3)}</body></html>"


def train(pages: DataFrame, rows: int = TRAIN_PAGES) -> Trees | None:
    """Trees fitted on at most *rows* pages, spread by a hash of the id, and on their furnished copies."""
    full = pages.where(F.length("html") > 0).select("page_id", "html")
    found = sample_by_hash(full, rows, full.count(), "page_id", "html").collect()
    rng, x, y = np.random.default_rng(3), [], []
    for r in found:
        nodes = parse(r["html"])
        if not _marked(nodes):  # nothing is known of its text
            continue
        for page in (r["html"], _furnished(r["html"], rng), _furnished(r["html"], rng)):
            if page is not None:
                nodes = parse(page)
                labels = distant_labels(nodes)
                made = [(features(nodes), labels)]
                if _marked(nodes):
                    made += [_unmarked(parse(page), labels, how) for how in (rng, None)]
                x += [m[0] for m in made]
                y += [m[1] for m in made]
    if not x or not np.concatenate(y).any():
        return None
    return Trees(np.concatenate(x), np.concatenate(y))


def extract(pages: DataFrame, model: Trees | None) -> DataFrame:
    """page_id, url, text, n_chars of every row; without a model all text outside known furniture."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, held, rows = [], [], 0

        def flush() -> None:
            if not held:
                return
            p = model.score(np.concatenate([features(n) for n in held]))
            at = 0
            for nodes in held:
                texts.append(main_text(nodes, decode(nodes, p[at : at + len(nodes)])))
                at += len(nodes)
            held.clear()

        for page in batch.column(2).to_pylist():
            nodes = parse(page)
            if model is None:
                texts.append(main_text(nodes, [n.tag not in _FURNITURE and not n.above >> 8 & 1 for n in nodes]))
                continue
            held.append(nodes)
            rows += len(nodes)
            if rows > 20_000:
                flush()
                rows = 0
        flush()
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html"), run, "page_id bigint, url string, text string, n_chars bigint")
