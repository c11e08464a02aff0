"""Main text of web pages: gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is read into a tree of block elements (inline markup only adds text to its block; scripts,
styles and the like add none). Each element gets features: its tag, tokens of class, id and
role, its parent's, depth, place among siblings and in the page, text, link, tag and punctuation
density of its subtree. Boosted trees give each element the probability that it isn't boilerplate.

Decoding picks for the whole tree at once: a dropped element drops all below it, a kept element leaves
its children the choice, and of all such choices the most likely one is taken, by one pass from the
leaves up. So no element is kept below a dropped one.

The trees are fitted on pages that ``teaching_pages`` composes from a seed: articles under many
structures, of one to some hundred paragraphs, between menus, notices, adverts, forms, comments and so on, labelled as
they are made. What the words of attributes say for or against content is counted there, too; no list of words is given to the
features. Half of the pages name their elements by what they are; others have no names, made-up or foreign ones, or
misleading ones, as articles have parts named "more" or "commentary", so trees must also tell by structure.

Defined results: a null or empty page has the empty text; broken markup is read as browsers
mostly do (an open paragraph ends where a block starts, stray end tags are skipped); repeated rows
are extracted each; an empty table gives no rows; other columns are ignored; page text is never capped.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from burrow.llm.textual import column, prepare

# How HTML's elements are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("annotation annotation-xml script style noscript template svg iframe object select option head title canvas audio video textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark math merror meter mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder nobr output progress semantics q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
SAME_LEVEL = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Tags from boilerplate to content, as the trees see them.
ORDER = "nav aside footer form fieldset menu dialog header address ul ol dl li dd dt table tbody tr td th figure figcaption center details summary div section body html hgroup pre blockquote p h6 h5 h4 h3 h2 h1 article main".split()
_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>\x00]*)", re.S)
_PLAIN = re.compile(r"[^>\"']*")
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SILENT}
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
N_FEATURES = 32


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str
    parent: Node | None
    depth: int
    #: Strings of text and block elements, in page order.
    parts: list = field(default_factory=list)
    inputs: int = 0
    main: bool = False


class _Attributes:
    """Finds where tags end. A quote that is never closed is a plain character; that it isn't is looked up once a page."""

    def __init__(self, page: str):
        self.page = page
        self.unclosed: set[str] = set()

    def end(self, pos: int) -> int:
        """The place of the > that closes the tag whose attributes begin at pos, or -1."""
        page = self.page
        while True:
            pos = _PLAIN.match(page, pos).end()
            if pos == len(page):
                return -1
            quote = page[pos]
            if quote == ">":
                return pos
            pos += 1
            if quote not in self.unclosed:
                close = page.find(quote, pos)
                if close < 0:
                    self.unclosed.add(quote)
                else:
                    pos = close + 1


class _Path:
    """The open elements from the root down, and for each tag where it is open."""

    def __init__(self, root: Node):
        self.open = [root]
        self.depths: dict[str, list[int]] = {}

    def nearest(self, tags: tuple[str, ...]) -> int:
        """The depth of the innermost open element of these tags, or -1."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=-1)

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def cut(self, depth: int) -> None:
        """Closes the element at depth and all in it."""
        while len(self.open) > depth:
            self.depths[self.open.pop().tag].pop()


def parse(page: str | None) -> Node:
    """The tree of a page's block elements below a root, in time linear in the page."""
    root = Node("html", "", None, 0)
    path, links, pos = _Path(root), 0, 0
    page = page or ""
    tags, never_closed = _Attributes(page), set()

    def text(s: str) -> None:
        if s:
            path.open[-1].parts.append((html.unescape(s), links > 0))

    end = len(page)
    while pos < end:
        m = _OPEN.search(page, pos)
        stop = m and (tags.end(m.end()) if m[2] else m.end())
        if not m or stop < 0:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        tag = (m[2] or "").lower()
        if not tag:
            pos = stop
            continue
        attributes, pos = page[m.end() : stop], stop + 1
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and tag not in SILENT and tag not in VOID and (depth := path.nearest((tag,))) > 0:
                path.cut(depth)
                links = 0
            continue
        if tag in SILENT:
            if tag in RAW or not attributes.rstrip().endswith("/"):
                close = _CLOSE[tag].search(page, pos) if tag not in never_closed else None
                if close:
                    pos = close.end()
                elif tag in RAW:
                    pos = end
                else:
                    never_closed.add(tag)
            continue
        at = path.open[-1]
        if tag in INLINE or tag in VOID:
            if tag == "a":
                links += 1
            elif tag in ("br", "img", "input"):
                at.parts.append((" ", False))
                if tag == "input":
                    at.inputs += 1
            elif tag == "hr":
                at.parts.append(Node("hr", "", at, at.depth + 1))
            continue
        if tag in ("html", "body"):
            if attributes and at is root:
                root.attributes = attributes
            continue
        links = 0
        if tag in CLOSES_P and (depth := path.nearest(("p", "table", "td"))) > 0 and path.open[depth].tag == "p":
            path.cut(depth)
        if tag in SAME_LEVEL and (depth := path.nearest((tag, *SAME_LEVEL[tag]))) > 0 and path.open[depth].tag == tag:
            path.cut(depth)
        at = path.open[-1]
        node = Node(tag, attributes, at, at.depth + 1)
        at.parts.append(node)
        path.push(node)
    return root


def nodes_of(root: Node) -> list[Node]:
    """All elements, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(p for p in reversed(n.parts) if isinstance(p, Node))
    return out


def _tokens(attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return ""
    return " ".join(next((g for g in m.groups()[1:] if g), "") for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() not in ("style", "hidden"))


_RANK = {t: i for i, t in enumerate(ORDER)}


_WORD = re.compile(r"[^\W\d_]+")
_CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Letters of a sub-word: what a word that wasn't learned is judged by.
HEAD = 5


def _words(tokens: str) -> set[str]:
    """Words of class, id and role tokens: cut at marks, digits and capitals."""
    return {w.lower() for w in _WORD.findall(_CAPITAL.sub(" ", tokens))}


def learned_words(nodes: list[Node]) -> dict[str, float]:
    """The log-odds of main content given that an element's own tokens have the word, or (with a star) a word that begins so; what fewer than ten elements have is left out."""
    seen: dict[str, list[int]] = {}
    for x in nodes:
        for w in _words(_tokens(x.attributes)):
            for part in (w, w[:HEAD] + "*"):
                seen.setdefault(part, [0, 0])[x.main] += 1
    return {w: math.log((yes + 1) / (no + 1)) for w, (no, yes) in seen.items() if yes + no >= 10}


def _odds(tokens: str, odds: dict[str, float]) -> list[float]:
    """Of each word, or of its beginning, if either was learned."""
    return [o for w in _words(tokens) if (o := odds.get(w, odds.get(w[:HEAD] + "*"))) is not None]


def features(nodes: list[Node], odds: dict[str, float]) -> np.ndarray:
    """One row per element; odds are those of ``learned_words``."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    chars, linked, words, marks, blocks, longest = ([0.0] * n for _ in range(6))
    tags, paragraphs, inputs, before = [0] * n, [0] * n, [0] * n, [0.0] * n
    against, favour, named = [0.0] * n, [0.0] * n, [0.0] * n
    total, worded, known, semantic = 0.0, 0, 0, any(x.tag in ("article", "main") for x in nodes)
    for i, x in enumerate(nodes):
        before[i] = total
        own = 0
        for p in x.parts:
            if not isinstance(p, Node):
                s = p[0].strip()
                if s:
                    k = len(s)
                    own += k
                    linked[i] += k * p[1]
                    words[i] += s.count(" ") + 1
                    marks[i] += s.count(".") + s.count(",") + s.count("?") + s.count("!")
        chars[i] = float(own)
        total += own
        blocks[i] = float(own > 0)
        longest[i] = float(own)
        tags[i] = 1
        paragraphs[i] = int(x.tag == "p")
        t = _tokens(x.attributes)
        if t:
            told = _odds(t, odds)
            worded += 1
            known += bool(told)
            against[i], favour[i], named[i] = min([0.0, *told]), max([0.0, *told]), sum(told)
        inputs[i] = x.inputs + (x.tag in ("form", "fieldset"))
    for i in range(n - 1, 0, -1):
        p = index[id(nodes[i].parent)]
        for a in (chars, linked, words, marks, blocks, tags, paragraphs, inputs):
            a[p] += a[i]
        longest[p] = max(longest[p], longest[i])
    out = np.zeros((n, N_FEATURES))
    above, around, over, inside = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
    place, siblings, alike = [0] * n, [1] * n, [1] * n
    for x in nodes:
        own = [index[id(s)] for s in x.parts if isinstance(s, Node)]
        same = Counter(nodes[i].tag for i in own)
        for k, i in enumerate(own):
            place[i], siblings[i], alike[i] = k, len(own), same[nodes[i].tag]
    for i, x in enumerate(nodes):
        p = index[id(x.parent)] if x.parent is not None else -1
        if p >= 0:
            above[i], around[i] = min(above[p], against[p]), max(around[p], favour[p])
            over[i], inside[i] = over[p] + named[p], inside[p]
        inside[i] += x.tag in ("article", "main")
        out[i] = (
            _RANK.get(x.tag, 25), _RANK.get(nodes[p].tag, 25) if p >= 0 else -1, x.depth, against[i], favour[i], above[i], around[i],
            math.log1p(chars[i]), linked[i] / (chars[i] + 1), math.log1p(tags[i]), chars[i] / tags[i], marks[i] / (words[i] + 1), words[i] / (blocks[i] + 1),
            place[i], siblings[i], alike[i], before[i] / (total + 1), chars[i] / (total + 1), math.log1p(longest[i]), paragraphs[i], inputs[i],
            chars[p] / (total + 1) if p >= 0 else 1.0, linked[p] / (chars[p] + 1) if p >= 0 else 0.0, paragraphs[p] if p >= 0 else 0, blocks[i], chars[i] / (words[i] + 1), named[i], over[i],
            inside[i], inside[i] if semantic else -1, known / (worded + 1), worded,
        )
    return out


@dataclass
class Trees:
    """Boosted regression trees of the logistic loss. Trees are full: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 90, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, share: float = 0.35, seed: int = 1) -> Trees:
        """Each tree is grown on a share of the rows, drawn anew."""
        rng = np.random.default_rng(seed)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]).astype(np.int32)
        base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), base)
        inner = (1 << depth) - 1
        feature, threshold = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf)
        value = np.zeros((trees, 1 << depth))
        every = np.arange(len(y))
        columns = np.arange(len(edges))[:, None]
        splits = np.arange(bins) < np.array([len(e) for e in edges])[:, None]
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            drawn = np.flatnonzero(rng.random(len(y)) < share)
            cells = binned[:, drawn] + columns * bins
            own = [np.tile(v[drawn], len(edges)) for v in (g, h)]
            part = np.zeros(len(drawn), np.int64)  # the node of its level that a row is in
            for level in range(depth):
                width = 1 << level
                code = (cells + part * (bins * len(edges))).ravel()
                gs, hs = (np.bincount(code, w, width * len(edges) * bins).reshape(width, len(edges), bins).cumsum(2) for w in own)
                g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
                gain = np.where(splits, gain, 0.0).reshape(width, -1)
                best = gain.argmax(1)
                split = (gain[np.arange(width), best] > 1e-6) & (np.bincount(part, minlength=width) >= 8)
                f, j = np.where(split, best // bins, 0), np.where(split, best % bins, 0)
                nodes = width - 1 + np.arange(width)
                feature[t, nodes] = f
                threshold[t, nodes] = [edges[f[k]][j[k]] if split[k] else np.inf for k in range(width)]
                part = 2 * part + (split[part] & (binned[f[part], drawn] > j[part]))
            gs, hs = (np.bincount(part, v[drawn], 1 << depth) for v in (g, h))
            value[t] = rate * gs / (hs + ridge)
            at = np.zeros(len(y), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[every, feature[t, at]] > threshold[t, at])
            margin += value[t][at - inner]
        return cls(feature, threshold, value, base, depth)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - len(c)]
        return out


def decode(nodes: list[Node], margins: np.ndarray) -> np.ndarray:
    """Which elements are kept: the most likely choice in which a dropped element keeps nothing below it."""
    index = {id(x): i for i, x in enumerate(nodes)}
    keep, drop = -np.logaddexp(0, -margins), -np.logaddexp(0, margins)
    whole, free = drop.copy(), keep.copy()  # of the subtree: all dropped; the element kept and the best below
    for i in range(len(nodes) - 1, 0, -1):
        p = index[id(nodes[i].parent)]
        whole[p] += whole[i]
        free[p] += max(whole[i], free[i])
    kept = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        kept[i] = free[i] >= whole[i] and (x.parent is None or kept[index[id(x.parent)]])
    return kept


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    """Text of the kept elements: blocks in page order, white space as one space, parted by an empty line."""
    index = {id(x): i for i, x in enumerate(nodes)}
    blocks: list[list[str]] = [[]]

    def walk(root: Node) -> None:
        todo: list = [iter(root.parts)]
        while todo:
            p = next(todo[-1], None)
            if p is None:
                todo.pop()
                blocks.append([])
            elif not isinstance(p, Node):
                blocks[-1].append(p[0])
            else:
                blocks.append([])
                if kept[index[id(p)]]:
                    todo.append(iter(p.parts))

    if kept[0]:
        walk(nodes[0])
    return "\n\n".join(s for b in blocks if (s := _SPACE.sub(" ", "".join(b)).strip()))


#: Names that pages give to elements, by what these are.
NAMES = {
    "menu": "nav menu navbar navigation top-nav main-menu breadcrumb breadcrumbs header site-header masthead topbar toolbar skip-link".split(),
    "notice": "cookie-notice cookie cookies consent gdpr notice alert banner popup modal overlay newsletter subscribe signup".split(),
    "advert": "ad ads advert advertisement ad-slot ad-container sponsored sponsor promo promotion banner".split(),
    "side": "sidebar side-bar side aside rail right-rail widget related related-posts recommended popular tags tag-list author-box more-stories".split(),
    "comments": "comments comment-list commentlist comment discussion responses replies respond disqus".split(),
    "form": "search search-form login form contact-form signup-form".split(),
    "foot": "footer site-footer foot page-footer copyright legal colophon disclaimer pagination pager".split(),
    "byline": "byline meta post-meta share share-buttons social social-links author tags".split(),
    "content": "content main-content post entry-content article-body story story-body text article entry body prose page-content hentry blog-post main".split(),
    "part": "section block chapter paragraph lead summary box note text-block columns column commentary more related-work info card reading body-text".split(),
    "wrapper": "wrapper wrap container page site layout".split(),
}
FOREIGN = {
    "menu": "kopf kopfzeile hauptmenue entete cabecera".split(),
    "notice": "hinweis meldung avis aviso".split(),
    "advert": "werbung anzeige publicite publicidad".split(),
    "side": "seitenleiste randspalte barre-laterale barra-lateral".split(),
    "comments": "kommentare leserbriefe commentaires comentarios".split(),
    "form": "suche anmeldung recherche buscar".split(),
    "foot": "fuss fusszeile impressum pied pie".split(),
    "byline": "teilen autor auteur".split(),
    "content": "inhalt beitrag haupttext contenu texte contenido texto".split(),
    "part": "abschnitt absatz partie apartado".split(),
    "wrapper": "seite rahmen conteneur pagina".split(),
}


def teaching_pages(n: int, seed: int, styles: tuple[str, ...] = ("named",) * 5 + ("bare", "made-up", "foreign", "misleading", "misleading")) -> list[Node]:
    """Parsed pages whose elements know whether they are main content. styles: how pages name their elements; each takes one."""
    rng = random.Random(seed)
    syllables = "ba re ti on er le st un de qua mi sol ke ran vo ert ing pla cho fu".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    pick = rng.choice
    style = "named"
    word = lambda: pick(vocabulary)
    sentence = lambda a=3, b=22: (" ".join(rng.choices(vocabulary, k=rng.randint(a, b))).capitalize() + pick(".....!?"))
    prose = lambda a=1, b=8: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda a=1, b=3: f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(a, b)))}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"

    def name(role: str) -> str:
        if style == "foreign":
            return pick(FOREIGN[role])
        if style == "misleading" and role == "part":
            return pick(NAMES[pick(list(NAMES))])
        return pick(NAMES[role])

    def sure(role: str) -> str:
        if style == "bare":
            return ""
        if style == "made-up":
            return pick([f' class="{word()}-{rng.randint(1, 99)}"', f' class="css-{word()}"', f' id="{word()}"', ""])
        own = name(role)
        return pick([f' class="{own}"', f' id="{own}"', f' class="{word()} {own}"', f' class="{own} {word()}"'])

    attr = lambda role: pick(["", sure(role), sure(role)])

    def menu() -> str:
        return pick([f"<nav{attr('menu')}>{links()}</nav>", f"<div{sure('menu')}>{links()}</div>", f"<header{attr('menu')}><h1>{word()}</h1>{links()}</header>", f"<header{attr('menu')}><div>{sentence(2, 6)}</div><nav>{links()}</nav></header>", f"<div{sure('menu')}><p>{sentence(2, 8)}</p>{links()}</div>"])

    def notice() -> str:
        return pick([f"<div{sure('notice')}>{pick(['', '<p>'])}{prose(1, 3)} {link()}</div>", f"<div{sure('notice')}><h3>{sentence(2, 5)}</h3><form><input type=text><p>{sentence()}</p></form></div>"])

    def advert() -> str:
        return pick([f"<div{sure('advert')}>{pick([prose(1, 3), '<p>' + prose(1, 4) + '</p>', link(), sentence(2, 9)])}</div>", f"<aside{attr('advert')}><p>{prose(1, 3)}</p></aside>"])

    def side() -> str:
        inner = pick([links(), f"<h3>{sentence(1, 4)}</h3>{links()}", f"<p>{prose(1, 3)}</p>", f"<h4>{word()}</h4><p>{sentence()}</p>{links()}"])
        return pick([f"<aside{attr('side')}>{inner}</aside>", f"<div{sure('side')}>{inner}</div>"])

    def comments() -> str:
        each = "".join(pick([f'<div{sure("comments")}><b>{word()}</b><p>{prose(1, 4)}</p></div>', f"<li><p>{prose(1, 3)}</p></li>", f"<div>{sentence()}</div>", f"<div{sure('comments')}>{prose(1, 3)}</div>", f'<article{sure("comments")}><p>{prose(1, 4)}</p></article>']) for _ in range(rng.randint(1, 6)))
        return pick([f"<section{sure('comments')}><h2>{word()}</h2>{each}</section>", f"<div{sure('comments')}>{each}</div>", f"<ol{sure('comments')}>{each}</ol>"])

    def form() -> str:
        return f"<form{attr('form')}><label>{sentence(1, 4)}</label><input><p>{sentence(2, 9)}</p></form>"

    def foot() -> str:
        inner = pick([f"&copy; {word()}.example.com &middot; {sentence()}", f"<p>&copy; {sentence()}</p>{links()}", f"<p>{prose(1, 3)}</p>", links()])
        return pick([f"<footer{attr('foot')}>{inner}</footer>", f"<div{sure('foot')}>{inner}</div>"])

    def byline() -> str:
        return pick([f'<div class="{pick(NAMES["byline"])}">{sentence(2, 5)}</div>', f'<div class="{pick(NAMES["byline"])}">{links()}</div>', f'<p class="{pick(NAMES["byline"])}">{sentence(2, 5)}</p>'])

    def article() -> str:
        k = rng.choice([1, 2, 4, 8, 14, 30] if rng.random() < 0.95 else [70, 160])
        body = []
        for _ in range(k):
            p = prose(1, pick([1, 2, 6, 14]))
            body.append(pick([f"<p>{p}</p>"] * 7 + [f"<p>{p}", f"<p><b>{sentence()}<br><p>{p}</p>", f"<p>{sentence()} {link()} {p}</p>", f"<h2>{sentence(1, 6)}</h2><p>{p}</p>", f"<blockquote><p>{p}</p></blockquote>", f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(rng.randint(2, 5)))}</ul>", f"<pre>{p}</pre>", f"<div>{p}</div>", f"<section><h3>{sentence(1, 5)}</h3><p>{p}</p></section>", f"<table><tr><td>{word()}</td><td>{sentence()}</td></tr></table>"]))
            if rng.random() < (0.3 if style == "misleading" else 0.1):
                body.append(pick([f"<div{sure('part')}><p>{prose(1, 5)}</p><p>{prose(1, 5)}</p></div>", f"<section{sure('part')}><h2>{sentence(1, 5)}</h2><p>{p}</p><p>{prose(1, 4)}</p></section>", f"<div{sure('part')}><p>{p}</p></div>", f"<ul>{''.join(f'<li>{link()} {sentence(4, 14)}</li>' for _ in range(rng.randint(2, 4)))}</ul>", f"<ul>{''.join(f'<li>{link(2, 6)}</li>' for _ in range(2))}</ul>"]))
            if rng.random() < min(0.08, 0.6 / k):
                body.append(f"<x-drop>{pick([advert, side, notice, form])()}</x-drop>")
        title = pick([f"<h1>{sentence(3, 9)}</h1>", f"<h1>{sentence(3, 9)}</h1>", "", f"<h2>{sentence(2, 8)}</h2>"])
        if rng.random() < 0.2:
            title += f"<x-drop>{byline()}</x-drop>"
        inner = title + "".join(body)
        if rng.random() < 0.1:
            inner += f"<x-drop>{pick([comments, side])()}</x-drop>"
        return pick([f"<article{attr('content')}>{inner}</article>"] * 3 + [f"<main{attr('content')}>{inner}</main>", f"<div{sure('content')}>{inner}</div>", f"<main><article>{inner}</article></main>", f"<div{attr('content')}>{inner}</div>", f"<section{attr('content')}>{inner}</section>", f"<div{sure('content')}><div{sure('content')}>{inner}</div></div>"])

    out = []
    for _ in range(n):
        style = pick(styles)
        drop = lambda s: f"<x-drop>{s}</x-drop>"
        top = [drop(f()) for f in rng.sample([menu, notice, advert, form, side], rng.randint(0, 4))]
        low = [drop(f()) for f in rng.sample([foot, comments, side, advert, form, foot], rng.randint(0, 4))]
        body = f"<x-main>{article()}</x-main>"
        if rng.random() < 0.25:  # a column of the article and what belongs to it
            body = f"<div{attr('wrapper')}>{body}{''.join(drop(f()) for f in rng.sample([byline, comments, side, advert], rng.randint(0, 3)))}</div>"
            if rng.random() < 0.5:
                body = f"<div{attr('wrapper')}>{body}{drop(side())}</div>"
        body = "".join(top) + body + "".join(low)
        if rng.random() < 0.3:
            body = f"<div{attr('wrapper')}>{body}</div>"
        root = parse(f"<html><head><title>{word()}</title></head><body>{body}</body></html>")
        out.append(_unmarked(root))
    return out


def _unmarked(root: Node) -> Node:
    """Takes the marking elements out; elements that hold main content, or are in it and not dropped, know it."""

    def visit(node: Node, inside: bool) -> bool:
        parts, holds = [], False
        for p in node.parts:
            if not isinstance(p, Node):
                parts.append(p)
            elif p.tag in ("x-main", "x-drop"):
                for q in p.parts:
                    if isinstance(q, Node):
                        q.parent = node
                        holds |= visit(q, p.tag == "x-main")
                    parts.append(q)
            else:
                holds |= visit(p, inside)
                parts.append(p)
        node.parts = parts
        node.main = inside or holds
        return node.main

    visit(root, False)
    for x in nodes_of(root):
        x.depth = x.parent.depth + 1 if x.parent is not None else 0
    return root


@dataclass
class Model:
    trees: Trees
    odds: dict[str, float]

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page."""
        read = [nodes_of(parse(h)) for h in pages]
        if not read:
            return []
        margins = self.trees.margins(np.concatenate([features(t, self.odds) for t in read]))
        ends = np.cumsum([len(t) for t in read])
        return [text_of(t, decode(t, margins[e - len(t) : e])) for t, e in zip(read, ends)]


@lru_cache(maxsize=4)
def fit(pages: int = 1200, seed: int = 7) -> Model:
    """Learns trees from pages, and words from half as many others, so that words don't seem surer than they are. A process learns once."""
    odds = learned_words([n for r in teaching_pages(pages // 2, seed + 1) for n in nodes_of(r)])
    read = [nodes_of(r) for r in teaching_pages(pages, seed)]
    return Model(Trees.fit(np.concatenate([features(t, odds) for t in read]), np.array([float(n.main) for t in read for n in t])), odds)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars (code points) per row."""
    prepare(pages.sparkSession)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = model.texts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(column(pages, "page_id", "long"), column(pages, "url", "string"), column(pages, "html", "string"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
