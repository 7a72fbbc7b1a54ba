"""The main text of web pages: boosted trees score the nodes of the page's tree, and a decision over
the whole tree keeps no node below one that it drops.

A page is parsed into blocks (elements that stand by themselves) and segments (the text between two
borders of blocks, with its inline markup). Each has features: its tag, the words of its class, id and
role and those above it, the text, links and punctuation of its subtree, depth, and its place among
its siblings. The trees give the log-odds that it holds main text if the node above it does; what is
kept is the choice of greatest likelihood, in which nothing below a dropped node is kept. The trees are
fitted to pages made by `made_page`, which lays out random articles among random menus, headers, footers,
sidebars, notices, adverts, forms and comments, with and without telling names. Parsing takes time in
proportion to a page's length, whatever is in it.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import gbt
from .common import extend, keyed

#: Elements within a line of text (fixed values); so are those unknown here, unless a "-" is in their names.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br label math svg object".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content a page doesn't show, or shows in controls (fixed values).
NEVER = set("head script style noscript template iframe select button textarea input canvas audio video option datalist title".split())
RAW_TAGS = set("script style textarea title noscript iframe template".split())
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW_TAGS}
#: Elements of a head; anything else ends one that isn't closed (fixed values).
IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
#: A start tag of a key ends an open element of its values (fixed values).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody"}}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
STOPS = set("table td th ul ol dl body html article section div aside nav main blockquote".split())
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
MARK = re.compile(r"""[>"']""")
#: Open blocks that have a level of their own in the tree; what is deeper stands on the last level.
DEEPEST = 200
ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Groups of tags and of attribute words (fixed values).
TAGS = {
    "article": "article", "main": "main", "p": "p", "head": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl menu", "item": "li dt dd", "div": "div section center details summary", "nav": "nav", "header": "header", "footer": "footer address",
    "aside": "aside", "form": "form fieldset dialog", "quote": "blockquote pre figure figcaption", "table": "table thead tbody tfoot tr td th caption", "body": "body html", "text": "#text",
}
WORDS = {
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs crumbs toc pagination pager topbar tabs links skip", "header": "header masthead head top logo brand hero sitehead banner branding",
    "footer": "footer foot bottom copyright legal colophon contentinfo imprint", "side": "side sidebar aside rail widget widgets related recommended more popular trending complementary archive tags",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner dfp adsense", "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner dialog toast warning subscribe newsletter paywall",
    "form": "form search login signup signin subscribe newsletter contact searchbox", "comment": "comment comments commentlist reply replies discussion disqus respond reader thread feedback review reviews",
    "share": "share sharing social follow author byline meta tags print email rating", "content": "article content post entry story body main text page articlebody maincontent hentry prose copy documentbody",
}
TAG_OF = {t: i for i, ts in enumerate(TAGS.values()) for t in ts.split()}
BLOCKS = set(TAG_OF) | NEVER | VOID - INLINE | set("hgroup legend optgroup search center dir frameset noframes".split())
WORD_OF: dict[str, list[int]] = {}
for _i, _ws in enumerate(WORDS.values()):
    for _w in _ws.split():
        WORD_OF.setdefault(_w, []).append(_i)


@dataclass
class Page:
    """Nodes in page order: parent (before its children, -1 for the root), tag, attribute word groups,
    whether it is barred, and for segments the text and its measures."""

    parent: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    barred: list[bool] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: int, words: int, barred: bool, text: str | None = None, linked: int = 0, inline: int = 0) -> int:
        for a, v in ((self.parent, parent), (self.tag, tag), (self.words, words), (self.barred, barred), (self.text, text), (self.linked, linked), (self.inline, inline)):
            a.append(v)
        return len(self.parent) - 1


def attribute_words(attrs: str) -> tuple[int, bool]:
    """The groups of the words in class, id, role and itemprop as bits; whether the element is hidden."""
    bits, hidden = 0, False
    for m in ATTR.finditer(attrs):
        name = m[1].lower()
        if name == "hidden":
            hidden = True
            continue
        for w in WORD.findall(m[2] or m[3] or m[4] or ""):
            for g in WORD_OF.get(w.lower(), ()):
                bits |= 1 << g
    return bits, hidden


def inline(tag: str) -> bool:
    return tag in INLINE or (tag not in BLOCKS and "-" not in tag)


class Tags:
    """Finds a page's tags one after another. What is read to find one is part of it, or read once a page."""

    def __init__(self, source: str):
        self.source, self.last, self.quotes = source, source.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        """Start, end, name (with "/" at an end tag; empty: a comment or the like) and attributes of the
        next tag from `at` on."""
        s = self.source
        while (i := s.find("<", at)) >= 0:
            if i > self.last:  # only a comment that isn't closed
                i = s.find("<!--", i)
                return (i, len(s), "", "") if i >= 0 else None
            if s.startswith("<!--", i):
                end = s.find("-->", i + 2)
                return i, len(s) if end < 0 else end + 3, "", ""
            if s[i + 1] in "!?":
                return i, s.find(">", i) + 1, "", ""
            if m := NAME.match(s, i + 1):
                end = self._end(m.end())
                return i, end + 1, m[0].lower(), s[m.end() : end]
            at = i + 1
        return None

    def _end(self, at: int) -> int:
        """Place of the ">" that ends a tag: none in a quoted value, as long as a page's values are closed."""
        s, k = self.source, at
        while self.quotes:
            m = MARK.search(s, k)
            if m and m[0] == ">":
                return m.start()
            j = m.start() if m else 0
            while m and s[j - 1].isspace():
                j -= 1
            k = m.end() if m else 0
            if m and s[j - 1] == "=":
                k = s.find(m[0], k) + 1
            self.quotes = k > 0
        return s.find(">", at)


class Open:
    """The open elements: name, node that holds their text, whether within an element that isn't shown."""

    def __init__(self, root: int):
        self.items: list[tuple[str, int, bool]] = [("html", root, False)]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks, self.stops = [0], [0]

    def push(self, tag: str, node: int, never: bool, block: bool) -> None:
        k = len(self.items)
        self.items.append((tag, node, never))
        self.places.setdefault(tag, []).append(k)
        if block:
            self.blocks.append(k)
            if tag in STOPS:
                self.stops.append(k)

    def top(self, tag: str) -> int:
        """Place of the last open element of this name, 0 if there is none (or it is the root)."""
        at = self.places.get(tag)
        return at[-1] if at else 0

    def pop(self, k: int) -> None:
        """Closes what is open from place k on."""
        while len(self.items) > k:
            at = self.places[self.items.pop()[0]]
            at.pop()
        while self.blocks[-1] >= k:
            self.blocks.pop()
        while self.stops[-1] >= k:
            self.stops.pop()

    def forget(self, k: int) -> None:
        """The element at place k ends for what follows; blocks within it stay open."""
        tag, node, never = self.items[k]
        self.places[tag].remove(k)
        self.items[k] = ("", node, never)
        self.places.setdefault("", []).append(k)


def parse(source: str) -> Page:
    """The page's blocks and segments. Broken markup is read as browsers mostly do: a block ends an open
    paragraph, an end tag without a start is nothing, what can't be in a head ends it, and what is open
    at the end is closed there."""
    page = Page()
    open_, tags = Open(page.add(-1, TAG_OF["body"], 0, False)), Tags(source)
    parts: list[str] = []
    linked = marks = 0

    def flush() -> None:
        nonlocal linked, marks
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, node, never = open_.items[-1]
                page.add(node, TAG_OF["#text"], 0, never, text, linked, marks)
            parts.clear()
        linked = marks = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            if open_.items[-1][0] == "head" and not raw.isspace():
                open_.pop(open_.top("head"))
            s = html.unescape(raw) if "&" in raw else raw
            parts.append(s)
            if open_.places.get("a"):
                linked += len(s)

    at, n = 0, len(source)
    while at < n:
        found = tags.next(at)
        if found is None:
            take(source[at:])
            break
        start, end, tag, attrs = found
        take(source[at:start])
        at = end
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            line, k = inline(tag), open_.top(tag)
            if not line:
                flush()
            if k and not (line and open_.blocks[-1] >= k):
                open_.pop(k)
            elif tag == "a" and k:
                open_.forget(k)
            continue
        if open_.items[-1][0] == "head" and tag not in IN_HEAD and tag != "head":
            flush()
            open_.pop(open_.top("head"))
        if tag == "br":
            parts.append("\n")
            continue
        if inline(tag):
            marks += 1
            if tag not in VOID and not attrs.rstrip().endswith("/"):
                open_.push(tag, *open_.items[-1][1:], False)
            continue
        flush()
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        k = max(map(open_.top, shut), default=0)
        if k and k >= open_.stops[-1]:
            open_.pop(k)
        words, hidden = attribute_words(attrs) if attrs else (0, False)
        never = open_.items[-1][2] or tag in NEVER or hidden
        if tag in ("body", "html") and open_.top("head"):
            open_.pop(open_.top("head"))
            never = open_.items[-1][2] or hidden
        if tag in RAW_TAGS:
            m = RAW_END[tag].search(source, at)
            at = m.start() if m else n
        if tag in VOID:
            continue
        last = open_.items[open_.blocks[min(len(open_.blocks), DEEPEST) - 1]][1]
        open_.push(tag, page.add(last, TAG_OF.get(tag, TAG_OF["div"]), words, never), never, True)
    flush()
    return page


NAMES = [*(f"tag_{t}" for t in TAGS), *(f"own_{w}" for w in WORDS), *(f"above_{w}" for w in WORDS), *(f"in_{t}" for t in ("article", "main", "nav", "header", "footer", "aside", "list", "table", "form")), *(f"parent_{t}" for t in ("article", "main", "div", "item", "body")),
         "depth", "chars", "words", "links", "commas", "stops", "inline", "share", "paragraphs", "headings", "kinds", "place", "siblings", "of_parent", "next_to", "digits"]


@dataclass
class Forest:
    """Nodes of many pages at once, by levels."""

    parent: np.ndarray
    levels: list[np.ndarray]
    leaf: np.ndarray
    barred: np.ndarray
    features: np.ndarray
    page_of: np.ndarray
    texts: list[str | None]


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.parent) for p in pages], np.int64)
    base = np.cumsum(sizes) - sizes
    cat = lambda name, kind=np.int64: np.concatenate([np.array(getattr(p, name), kind) for p in pages]) if pages else np.zeros(0, kind)
    parent = cat("parent")
    page_of = np.repeat(np.arange(len(pages)), sizes)
    parent = np.where(parent >= 0, parent + base[page_of], -1)
    tag, words, barred = cat("tag"), cat("words"), cat("barred", bool)
    texts = [t for p in pages for t in p.text]
    leaf = np.fromiter((t is not None for t in texts), bool, len(texts))
    n = len(parent)
    level = np.arange(n)[parent < 0]
    depth = np.zeros(n, np.int64)
    order = np.argsort(parent, kind="stable")
    at = np.searchsorted(parent[order], np.arange(n + 1))
    levels = []
    while len(level):
        levels.append(level)
        count = at[level + 1] - at[level]
        starts = np.repeat(at[level] - np.cumsum(count) + count, count)
        level = order[starts + np.arange(count.sum())]
        depth[level] = len(levels)
    s = np.zeros((n, 8))
    for i, t in enumerate(texts):
        if t is not None:
            s[i, :4] = len(t), t.count(" ") + 1, t.count(","), t.count(".")
    digits = np.fromiter((sum(map(t.count, "0123456789")) if t else 0 for t in texts), float, n)
    s[:, 4], s[:, 5] = cat("linked"), cat("inline")
    s[:, 6] = tag == TAG_OF["p"]
    s[:, 7] = tag == TAG_OF["h1"]
    own_chars = s[:, 0].copy()
    for level in levels[:0:-1]:
        np.add.at(s, parent[level], s[level])
        np.add.at(digits, parent[level], digits[level])
    ones = (words[:, None] >> np.arange(len(WORDS)) & 1).astype(np.float32)
    kinds = np.eye(len(TAGS), dtype=np.float32)[tag]
    inside = [list(TAGS).index(t) for t in ("article", "main", "nav", "header", "footer", "aside", "list", "table", "form")]
    above, within = np.zeros_like(ones), np.zeros((n, len(inside)), np.float32)
    for level in levels[1:]:
        p = parent[level]
        above[level] = np.maximum(above[p], ones[p])
        within[level] = np.maximum(within[p], kinds[p][:, inside])
    # a root stands above itself, so that a page's features are the same whatever it is read with
    up = np.where(parent >= 0, parent, np.arange(n))
    siblings = np.bincount(up[parent >= 0], minlength=n)
    rank = np.zeros(n)
    below = order[len(pages) :]
    rank[below] = np.arange(len(pages), n) - at[parent[below]]
    page_chars = s[base[page_of], 0] if n else own_chars
    chars = s[:, 0]
    part = lambda a, b: (a / np.maximum(b, 1)).astype(np.float32)
    before = np.zeros(n)
    has = (parent >= 0) & (rank > 0)
    before[order[1:]] = np.where(parent[order[1:]] == parent[order[:-1]], chars[order[:-1]], 0)
    parents = kinds[up][:, [list(TAGS).index(t) for t in ("article", "main", "div", "item", "body")]]
    x = np.concatenate([
        kinds, ones, above, within, parents,
        np.stack([np.minimum(depth, 20), np.log1p(chars), np.log1p(s[:, 1]), part(s[:, 4], chars), part(s[:, 2], s[:, 1]), part(s[:, 3], s[:, 1]), part(s[:, 5], s[:, 1]), part(chars, page_chars), np.log1p(s[:, 6]), np.log1p(s[:, 7]),
                  np.log1p(siblings), part(rank, siblings[up]), np.log1p(siblings[up]), part(chars, chars[up]), np.log1p(np.where(has, before, 0)), part(digits, chars)], axis=1).astype(np.float32),
    ], axis=1)
    return Forest(parent, levels, leaf, barred, x, page_of, texts)


def decode(f: Forest, score: np.ndarray) -> np.ndarray:
    """The kept nodes: the choice of greatest likelihood. What is below a dropped node is dropped; a node
    below a kept one is kept by the odds of its score, a barred one never."""
    best = -np.logaddexp(0, -score)  # of the subtree, if the node is kept
    drop = -np.logaddexp(0, score)
    best[f.barred] = -np.inf
    drop[f.barred] = 0
    for level in f.levels[:0:-1]:
        np.add.at(best, f.parent[level], np.maximum(best[level], drop[level]))
    kept = best > drop
    for level in f.levels[1:]:
        kept[level] &= kept[f.parent[level]]
    return kept


def main_texts(pages: list[Page], trees: gbt.Trees) -> list[str]:
    """The kept segments of each page in order, joined by spaces."""
    f = forest(pages)
    kept = decode(f, trees.score(f.features)) & f.leaf
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(kept).tolist():
        out[f.page_of[i]].append(f.texts[i])
    return [" ".join(x) for x in out]


SYLLABLES = "ka to ri men sol ve lu an der pi qua es".split()
#: Words of made pages, some with a comma or full stop at their ends.
WORDS_MADE = [a + b + e for a in SYLLABLES for b in ["", *SYLLABLES] for e in ["", "", "", "", "", "", "", "", ".", ","]]


def made_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the segments of its main text; every segment has a number that no other one has."""
    made: list[str] = []
    def words(n: int) -> str:
        return " ".join(rng.choices(WORDS_MADE, k=n))

    def text(n: int, main: bool = False) -> str:
        s = f"{words(max(1, n))} {len(made)}x{rng.randint(0, 9)}"
        made.append(s if main else "")
        return s

    plain = rng.random() < 0.3  # no telling names
    semantic = rng.random() < 0.6

    def box(tag: str, names: list[str], inner: str) -> str:
        tag = tag if semantic else "div"
        if plain and (tag == "div" or rng.random() < 0.5):
            name = ["", ' class="c%d"' % rng.randint(1, 99), ' class="col row"', ' id="b%d"' % rng.randint(1, 9)][rng.randint(0, 3)]
        else:
            name = rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="x {rng.choice(names)}-box"', "" if tag != "div" else f' class="{rng.choice(names)}"'])
        return f"<{tag}{name}>{inner}</{tag}>"

    def link(n: int) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{text(n)}</a>'

    def menu() -> str:
        items = [link(rng.randint(1, 3)) for _ in range(rng.randint(3, 9))]
        return box("nav", ["nav", "menu", "navbar", "breadcrumb", "topnav"], rng.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items)]))

    def header() -> str:
        inner = rng.choice([f"<h1>{text(rng.randint(1, 5))}</h1>", f"<p>{text(4)}</p>", link(2), f"<p class=site-title>{link(rng.randint(1, 3))}</p>", f"<div class=branding>{link(2)}<span>{text(4)}</span></div>"])
        return box("header", ["header", "masthead", "site-header", "top"], inner + (menu() if rng.random() < 0.5 else ""))

    def footer() -> str:
        return box("footer", ["footer", "site-footer", "copyright", "bottom"], rng.choice([f"&copy; {text(rng.choice([3, 8, 20, 40]))}", f"<p>{text(rng.choice([4, 8, 30]))}</p>" + menu(), " &middot; ".join(link(1) for _ in range(4))]))

    def side() -> str:
        inner = "".join(rng.choice([f"<h3>{text(2)}</h3>", f"<p>{text(rng.randint(4, 30))}</p>", "<ul>" + "".join(f"<li>{link(4)}</li>" for _ in range(4)) + "</ul>"]) for _ in range(rng.randint(1, 4)))
        return box("aside", ["sidebar", "side", "related", "widget", "aside"], inner)

    def advert() -> str:
        return box(rng.choice(["div", "aside"]), ["ad", "ads", "advert", "sponsored", "promo", "banner-ad"], rng.choice([text(rng.randint(3, 20)), f"<p>{text(rng.randint(3, 25))}</p>", link(6)]))

    def notice() -> str:
        return box("div", ["cookie-notice", "notice", "consent", "alert", "newsletter", "popup"], rng.choice([f"<p>{text(rng.randint(5, 25))}</p>", text(10) + link(1)]))

    def form() -> str:
        fields = "".join(f"<p><label>{text(rng.randint(1, 3))}</label> <input name=q{i}></p>" for i in range(rng.randint(1, 5)))
        inner = rng.choice([f"{text(3)}<input name=q><label>{text(2)}</label>", fields, f"<fieldset><legend>{text(2)}</legend>{fields}</fieldset>", f"<p>{text(rng.randint(4, 25))}</p>{fields}"])
        return f"<form{rng.choice(['', ' action=/s', ' class=' + rng.choice(['search', 'login', 'signup', 'contact'])])}>{inner}<button>{text(1)}</button></form>"

    def comments() -> str:
        one = lambda: box(rng.choice(["div", "article", "section", "li"]), ["comment", "reply", "comment-body"], rng.choice([f"<p>{text(rng.randint(4, 50))}</p>", f"<b>{text(1)}</b><p>{text(rng.randint(5, 60))}</p>"]))
        tag = rng.choice(["section", "div", "ul", "aside"])
        return f'<{tag} {rng.choice(["id", "class"])}="{rng.choice(["comments", "comment-list", "discussion", "replies", "reader-comments"])}">' + (f"<h2>{text(2)}</h2>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    def share() -> str:
        return box("div", ["share", "social", "author-meta", "byline"], " ".join(link(1) for _ in range(3)))

    def body() -> str:
        out = [f"<h1>{text(rng.randint(2, 10), True)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            k = rng.random()
            if k < 0.68:
                p = text(rng.choice([1, 3, 8, 20, 40, 80, 150]), True)
                if rng.random() < 0.05:
                    p = p.replace(" ", rng.choice([" <math><mi>x</mi><mo>=</mo></math> ", " <svg><text>y</text></svg> ", " <object>z</object> "]), 1)
                    made[-1] = " ".join(html.unescape(re.sub("<[^>]*>", "", p)).split())
                out.append(rng.choice([f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br>", f"<div>{p}</div>" if rng.random() < 0.3 else f"<p><i>{p}</i></p>"]))
            elif k < 0.76:
                out.append(f"<h{rng.randint(2, 4)}>{text(rng.randint(1, 6), True)}</h2>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>{text(rng.randint(2, 14), True)}" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif k < 0.89:
                out.append(f"<blockquote><p>{text(rng.randint(4, 30), True)}</p></blockquote>")
            elif k < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{text(2, True)}</td><td>{text(3, True)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif k < 0.94:
                out.append(f"<pre>{text(10, True)}</pre>")
            elif k < 0.96:
                out.append(f'<p><a href="#">{text(4, True)}</a></p>')
            elif k < 0.98:
                out.append(advert())
            else:
                out.append(share())
        inner = "".join(out)
        kind = rng.random()
        if kind < 0.55:
            inner = f"<article{rng.choice(['', '', ' class=post', ' id=c7'])}>{inner}</article>"
        elif kind < 0.8:
            names = ["content", "post-body", "entry-content", "story", "article-text", "main-content"]
            inner = f'<div class="{rng.choice(names)}">{inner}</div>'
        elif kind < 0.9:
            inner = f"<div>{inner}</div>"
        if rng.random() < 0.35 or kind >= 0.8:
            inner = f"<main>{inner}{comments() if rng.random() < 0.2 else ''}</main>"
        return inner

    top = [f() for f in (header, menu, notice, advert, form) if rng.random() < 0.45]
    end = [f() for f in (share, side, comments, advert, footer, notice) if rng.random() < 0.45]
    rng.shuffle(top)
    middle = body()
    if rng.random() < 0.3:
        middle = f"<div>{side() if rng.random() < 0.5 else ''}{middle}</div>"
    kind = rng.random()
    if kind < 0.15:  # laid out by a table
        row = lambda inner: f"<tr><td{rng.choice(['', ' colspan=2', ' align=center'])}>{inner}</td></tr>"
        links = rng.choice([menu, lambda: "<br>".join(link(rng.randint(1, 3)) for _ in range(rng.randint(2, 7))), lambda: " | ".join(link(1) for _ in range(rng.randint(2, 5)))])
        page = f"<table{rng.choice(['', ' width=760', ' border=0'])}>{row(''.join(top) + links())}<tr><td width=160>{links()}{side() if rng.random() < 0.3 else ''}</td><td>{middle}</td></tr>{row(''.join(end) + text(rng.randint(1, 6)))}</table>"
    else:
        page = "".join(top) + middle + "".join(end)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            page = f"<div{rng.choice(['', ' id=page', ' class=site', ' class=wrapper', ' class=container', ' id=site', ' class=layout'])}>{page}</div>"
    if rng.random() < 0.1:  # one form around it all
        page = f'<form method="post" id="{rng.choice(["aspnetForm", "form1", "mainform"])}"><input type="hidden" name="s">{rng.choice([page, f"<div>{page}</div>"])}</form>'
    head = f"<title>{words(4)}</title><style>p{{}}</style>"
    source = "<!DOCTYPE html>" + rng.choice([f"<html><head>{head}</head><body>{page}</body></html>"] * 4 + [f"{head}{page}", f"<head>{head}<body>{page}"])
    return source, {m for m in made if m}


@lru_cache(maxsize=4)
def train(pages: int = 2000, seed: int = 5) -> gbt.Trees:
    """Fits the trees to made pages, once a process: to the roots and the nodes below those that hold main
    text. A block is positive if a segment of main text lies in it."""
    rng = random.Random(seed)
    made = [made_page(rng) for _ in range(pages)]
    f = forest([parse(source) for source, _ in made])
    y = np.zeros(len(f.parent))
    for i in np.flatnonzero(f.leaf).tolist():
        y[i] = f.texts[i] in made[f.page_of[i]][1]
    for level in f.levels[:0:-1]:
        np.maximum.at(y, f.parent[level], y[level])
    use = ~f.barred & ((f.parent < 0) | (y[np.maximum(f.parent, 0)] > 0))
    return gbt.fit(f.features[use], y[use], rounds=80, share=0.5)


def extract(df: DataFrame, trees: gbt.Trees, source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """df with text, the main text of its pages, and n_chars, its code points.

    Null and empty pages, and pages without main text, have the empty text. White space of any kind
    becomes one space within a block. Columns of these names are replaced. What a page doesn't show
    (its head, scripts, styles, hidden elements, what stands in for media and frames) and the text of
    controls is no text of it.
    """

    def make():
        def step(batch):
            out: list[str] = []
            column = batch.column(batch.schema.get_field_index(source))
            for i in range(0, len(column), 512):
                out += main_texts([parse(s or "") for s in column.slice(i, 512).to_pylist()], trees)
            return {"text": out, "n_chars": [len(t) for t in out]}

        return step

    return extend(df, {"text": "string", "n_chars": "long"}, make, [source], keep=keep)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; the empty text for null, empty and articleless pages."""
    pages = keyed(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_id="page_id", url="url", html="html")
    return extract(pages, train(), keep=["page_id", "url"])
