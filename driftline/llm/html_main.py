"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of block elements with its text blocks as leaves. Each node is boilerplate, content, or a container
of both. Node potentials come from a softmax over features of the element (its tag, words of its class and id, amount and share of
text and links, repetition among its siblings); parent-child potentials say how likely a child's state is given its parent's. Sum-product messages go
up and down the trees of a whole batch, level by level, and a text block stays if its content marginal is at least a half.

The potentials are trained from labelled pages: pages laid out by `labelled_page` with a label on every element, and up to
MOST_LABELLED pages (MOST_CHARACTERS in all) of the table whose article element marks the content. On half of the laid-out pages names say
nothing or mislead, so that no single word of a class decides; labels never come from such words.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table

BOILERPLATE, CONTENT, CONTAINER = 0, 1, 2
#: Pages of the table that are learned from, their characters in all, and pages laid out here.
MOST_LABELLED, MOST_CHARACTERS, LAID_OUT, SEED = 100, 20_000_000, 500, 5

# HTML's element groups, and words that classes, ids and tags carry.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object title select annotation annotation-xml".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
FORMULA = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mspace mstyle semantics".split())
INLINE |= FORMULA
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTROLS = frozenset("input button textarea select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OFF_TAGS = frozenset("nav aside footer header form dialog menu address".split())
# Beginnings of words that speak of boilerplate, and of content.
AVOID = re.compile(
    r"(?:ads?|adbox|adslot|adsense|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|submenu|masthead|header|topbar|foot\w*|colophon|sidebar\w*|side|aside|rail|notic\w*|"
    r"cookie\w*|consent|gdpr|alert\w*|popup\w*|modal|overlay|form\w*|newsletter\w*|subscri\w*|sign(?:up|in)|login|register|search\w*|social|shar\w+|follow\w*|related|recommend\w*|"
    r"popular|trending|breadcrumb\w*|pagination|pager|tags?|taglist|toolbar|widget\w*|comment\w*|repl(?:y|ies)|respon[ds]\w*|disqus|discuss\w*|feedback|reader\w*|copyright|legal|disclaimer|skip|"
    r"hidden|print|toc|outbrain|taboola|paywall|dialog|address)"
)
PREFER = re.compile(r"(?:article\w*|main\w*|contents?|post|story|entry|prose|text|body|blogpost|hentry|page)")
TALK = re.compile(r"\b(?:repl(?:y|ies)|says?|said|wrote|posted|ago|comments?|responses?|likes?|antworten?|kommentare?|répondre|commentaires?|responder|comentarios?)\b", re.I)

FEATURES = 44
_ATTRIBUTES = r"((?>[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?+)*+)"  # a quote opens a value only right after =
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+){_ATTRIBUTES}(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LABEL = re.compile(r"data-l=\"(\d)\"")


def names_of(attributes: str) -> tuple[int, int, str]:
    """(avoid, prefer, names) of an element: 2 where the last word of a class or id speaks, 1 where only another word does."""
    avoid = prefer = 0
    found = [m[1].strip("\"'") for m in _NAMES.finditer(attributes)]
    for token in " ".join(found).split():
        words = [w.lower() for w in _WORDS.findall(token)]
        for i, w in enumerate(words):
            last = 2 if i == len(words) - 1 else 1
            if AVOID.fullmatch(w):
                avoid = max(avoid, last)
            elif PREFER.fullmatch(w):
                prefer = max(prefer, last)
    return avoid, prefer, " ".join(found)


@dataclass
class Tree:
    """Nodes in page order: parents come before children. text is set for leaves."""

    parent: list[int]
    depth: list[int]
    tag: list[str]
    avoid: list[int]
    prefer: list[int]
    names: list[str]
    text: list[str | None]
    linked: list[int]
    controls: list[int]
    label: list[int]


def squeeze(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def tree_of(page: str) -> Tree:
    """Reads a whole page, however malformed. Scripts, styles, titles and other raw elements leave no text."""
    t = Tree([-1], [0], ["#root"], [0], [0], [""], [None], [0], [0], [-1])
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with the node they belong to; inline ones share their parent's
    open_: dict[str, int] = {}  # how many of each tag are open
    parts: list[str] = []
    linked, at, n = 0, 0, len(page)

    def node(tag: str, attributes: str, text: str | None, links: int) -> int:
        up = stack[-1][1]
        avoid, prefer, names = names_of(attributes) if attributes else (0, 0, "")
        t.parent.append(up)
        t.depth.append(t.depth[up] + 1)
        t.tag.append(tag)
        t.avoid.append(avoid)
        t.prefer.append(prefer)
        t.names.append(names)
        t.text.append(text)
        t.linked.append(links)
        t.controls.append(0)
        m = _LABEL.search(attributes) if attributes else None
        t.label.append(int(m[1]) if m else -1)
        return len(t.parent) - 1

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = squeeze("".join(parts))
            if text:
                node("#text", "", text, min(linked, len(text)))
            parts.clear()
        linked = 0

    def close(names: set[str] | frozenset[str]) -> None:
        """Closes the innermost open element of these names and all within it."""
        while len(stack) > 1:
            tag, _ = stack.pop()
            open_[tag] -= 1
            if tag in names:
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            raw = page[at : m.start()]
            parts.append(raw)
            if open_.get("a"):
                linked += len(raw)
        at = m.end()
        ending, tag, attributes = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            if open_.get(tag):
                if tag not in INLINE:
                    end_block()
                    close({tag})
                elif stack[-1][0] == tag:
                    close({tag})
                else:  # a misnested inline end closes only inline elements
                    i = len(stack) - 1
                    while stack[i][0] != tag and stack[i][0] in INLINE:
                        i -= 1
                    if stack[i][0] == tag:
                        close({tag})
            elif tag in ("p", "br"):
                end_block() if tag == "p" else parts.append(" ")
            continue
        if tag in RAW and not (tag == "svg" and attributes.endswith("/")):  # only foreign elements close themselves
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else n
            if tag in CONTROLS:
                t.controls[stack[-1][1]] += 1
            continue
        if tag in CONTROLS:
            t.controls[stack[-1][1]] += 1
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag in ("br", "img", "wbr"):
                parts.append(" " if tag != "wbr" else "")
            continue
        if tag in INLINE:
            if attributes.endswith("/") and tag in FORMULA:
                continue
            stack.append((tag, stack[-1][1]))
            open_[tag] = open_.get(tag, 0) + 1
            continue
        end_block()
        if tag in CLOSES_P and open_.get("p"):
            close({"p"})
        own = SAME_CLOSES.get(tag)
        if own:
            scope = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in own or stack[i][0] in ("ul", "ol", "dl", "table")), 0)
            if scope and stack[scope][0] in own:
                close(own)
        if attributes.endswith("/") and tag not in CLOSES_P:
            continue
        stack.append((tag, node(tag, attributes, None, 0)))
        open_[tag] = open_.get(tag, 0) + 1
    end_block()
    return t


def features_of(t: Tree) -> np.ndarray:
    """(nodes, FEATURES) of 0 and 1."""
    n = len(t.parent)
    size = [len(x) if x else 0 for x in t.text]
    links, controls, leaves = list(t.linked), list(t.controls), [int(x is not None) for x in t.text]
    holds, titled, talks = [False] * n, [False] * n, [False] * n
    alike: dict[tuple, int] = {}
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        size[p] += size[i]
        links[p] += links[i]
        controls[p] += controls[i]
        leaves[p] += leaves[i]
        titled[p] |= titled[i] or t.tag[i] == "h1"
        if t.text[i] is None:
            if leaves[i] > 1 and t.tag[i] not in ("ul", "ol", "table", "tr"):
                key = (p, t.tag[i], t.names[i])
                alike[key] = alike.get(key, 0) + 1
        elif t.tag[p] in HEADINGS and size[i] < 80 and any(AVOID.fullmatch(w) for w in t.text[i].lower().split()):
            talks[t.parent[p]] = True
    marked = [i for i in range(n) if t.tag[i] in ("article", "main")]  # comments and teasers are marked so, too
    most = max(max((size[i] for i in marked), default=0), size[0] // 2)
    lead = {i for i in marked if titled[i]} or {i for i in marked if 2 * size[i] >= most}
    for i in range(n - 1, 0, -1):
        holds[t.parent[i]] |= holds[i] or i in lead
    within, total, rows = [False] * n, max(size[0], 1), []
    for i in range(n):
        p, text = t.parent[i], t.text[i]
        leaf = text is not None
        tag = t.tag[p] if leaf else t.tag[i]
        within[i] = i > 0 and (within[p] or p in lead)
        chars, share = size[i], links[i] / size[i] if size[i] else 0.0
        on = [0, 1 if leaf else 2]
        if leaf:
            on.append(18 + (0 if chars < 25 else 1 if chars < 80 else 2 if chars < 250 else 3))
            if text[-1] in ".!?:;…\"”»":
                on.append(31)
            if chars < 80 and TALK.search(text):
                on.append(35)
        else:
            main = i in lead
            if tag in OFF_TAGS:
                on.append(37 if tag == "header" and within[i] and titled[i] else 3)
            elif t.avoid[i]:
                on.append(9 if main else 10 if holds[i] else 4 if t.avoid[i] == 2 else 5)
            if t.prefer[i] and tag not in ("html", "body"):
                on.append(6 if t.prefer[i] == 2 else 7)
            if main:
                on.append(8)
            if holds[i]:
                on.append(34)
            on.append(22 + (0 if chars < 25 else 1 if chars < 120 else 2 if chars < 500 else 3))
            if chars >= 0.5 * total:
                on.append(32)
            elif chars >= 0.15 * total:
                on.append(33)
            if alike.get((p, tag, t.names[i]), 0) > 1:
                on.append(36)
            if talks[i]:
                on.append(35)
            if titled[i]:
                on.append(42 if chars >= 0.15 * total else 43)
        on.append(12 if tag == "p" else 13 if tag in HEADINGS else 14 if tag in ("li", "ul", "ol", "dl", "dt", "dd") else 15 if tag in ("div", "section", "td") else 16 if tag in ("html", "body", "#root") else 17)
        on.append(26 if share < 0.05 else 27 if share < 0.4 else 28 if share < 0.8 else 29)
        if within[i]:
            on.append(11)
        elif not holds[0]:
            on.append(40 if leaf else 39)
        elif not holds[i] and i not in lead:
            on.append(41 if leaf else 38)
        if controls[i]:
            on.append(30)
        rows.append(on)
    out = np.zeros((n, FEATURES))
    out[np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)] = 1.0
    return out


@dataclass
class Potentials:
    """weights (features x 3), prior (3), root (3), edge (parent state x child state): logs. leaf: the power of the text
    blocks' own potentials (many of them hang on one parent and are not independent), element: that of the elements'.
    Both are chosen by the likelihood of the labels."""

    weights: np.ndarray
    prior: np.ndarray
    root: np.ndarray
    edge: np.ndarray
    leaf: float = 1.0
    element: float = 1.0


def marginals(x: np.ndarray, parent: np.ndarray, depth: np.ndarray, model: Potentials) -> np.ndarray:
    """(nodes, 3): sum-product over a forest; a root's parent is -1. Works level by level on all trees at once."""
    own = x @ model.weights
    own -= own.max(axis=1, keepdims=True)
    own -= np.log(np.exp(own).sum(axis=1, keepdims=True))
    own -= model.prior
    own *= np.where(x[:, 1] > 0, model.leaf, model.element)[:, None]
    edge = np.exp(model.edge)
    levels = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[levels], np.arange(int(depth.max()) + 2))
    up, message = own.copy(), np.zeros_like(own)
    for d in range(len(cuts) - 2, 0, -1):
        i = levels[cuts[d] : cuts[d + 1]]
        top = up[i].max(axis=1, keepdims=True)
        message[i] = np.log(np.exp(up[i] - top) @ edge.T + 1e-300) + top
        np.add.at(up, parent[i], message[i])
    belief = up.copy()
    roots = levels[cuts[0] : cuts[1]]
    belief[roots] += model.root
    for d in range(1, len(cuts) - 1):
        i = levels[cuts[d] : cuts[d + 1]]
        without = belief[parent[i]] - message[i]
        top = without.max(axis=1, keepdims=True)
        belief[i] = up[i] + np.log(np.exp(without - top) @ edge + 1e-300) + top
    belief -= belief.max(axis=1, keepdims=True)
    belief = np.exp(belief)
    return belief / belief.sum(axis=1, keepdims=True)


def labels_by_article(t: Tree) -> list[int]:
    """States of a page whose article elements mark the content: what is in them, but for elements whose tag says that
    they are something else, is content. Names are not looked at."""
    n = len(t.parent)
    state = [BOILERPLATE] * n
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        holds[i] |= t.tag[i] == "article"
        holds[t.parent[i]] |= holds[i]
    for i in range(n):
        up = state[t.parent[i]] if i else CONTAINER
        state[i] = CONTENT if (t.tag[i] == "article" or up == CONTENT) and t.tag[i] not in OFF_TAGS and up != BOILERPLATE else CONTAINER if holds[i] and up == CONTAINER else BOILERPLATE
    return state


def labels_given(t: Tree) -> list[int]:
    """States written on the elements; what has none is as its parent."""
    state: list[int] = []
    for i, given in enumerate(t.label):
        state.append(given if given >= 0 else state[t.parent[i]] if i else CONTAINER)
        if t.text[i] is not None and state[i] == CONTAINER:
            state[i] = BOILERPLATE
    return state


# Names that the laid-out pages carry, by what the element is: fixed values.
NAMES = {
    "nav": "main-menu navbar nav-links menu breadcrumbs", "header": "masthead site-header topbar page-header", "footer": "site-footer footer colophon", "side": "sidebar right-rail widget-area side-box",
    "notice": "cookie-notice consent alert notice", "ad": "ad advert sponsored promo-box banner", "form": "newsletter search subscribe signup-box", "comments": "comments comment-list reader-comments discussion responses",
    "related": "related share tags recommended", "content": "content post-body story entry-content article-text main-column", "wrapper": "wrapper page-body container layout",
    "misleading": "share-friendly no-sidebar ad-free print-ready has-comments with-header social-policy form-free menu-open", "flattering": "text-small body-font content-box page-part",
}


def labelled_page(rng: random.Random, names: dict[str, str] = NAMES, speaking: float = 0.5) -> str:
    """A page in one of many layouts with data-l (state) on its elements. With a chance of 1 - speaking its names are
    made up; else they are of `names`."""
    words = "lo ra men tis ure dol an pre sit vel cor nec ius fer quam".split()
    speaks, semantic = rng.random() < speaking, rng.random() < 0.5

    def say(a: int, b: int) -> str:
        return " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(a, b))).capitalize()

    made: dict[str, str] = {}

    def name(kind: str, label: int) -> str:
        own = rng.choice(names[kind].split()) if speaks else made.setdefault(kind, "-".join(rng.choices(words, k=2)))
        if rng.random() < 0.25:
            own += " " + rng.choice(names["misleading" if label else "flattering"].split())
        return f' {rng.choice(["class", "class", "id"])}="{own}" data-l="{label}"' if rng.random() < 0.9 else f' data-l="{label}"'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{say(1, 4)}</a></li>' for _ in range(k)) + "</ul>"

    def text(k: int) -> str:
        return "".join(f"<p>{say(*rng.choice(((1, 5), (6, 60), (20, 60))))}.</p>" for _ in range(k))

    def table() -> str:
        row = lambda cell, k: "<tr>" + "".join(f"<{cell}>{rng.choice([say(1, 3), str(rng.randint(1, 3000))])}</{cell}>" for _ in range(k)) + "</tr>"
        k = rng.randint(2, 4)
        return "<table>" + (row("th", k) if rng.random() < 0.5 else "") + "".join(row("td", k) for _ in range(rng.randint(1, 5))) + "</table>"

    def definitions() -> str:
        return "<dl>" + "".join(f"<dt>{say(1, 2)}</dt><dd>{say(2, 12)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"

    def figure() -> str:
        return f"<figure><img><figcaption>{say(2, 12)}</figcaption></figure>" if rng.random() < 0.5 else f"<pre>{say(3, 30)}</pre>"

    def listing() -> str:
        item = lambda: f'<a href="#">{say(1, 6)}</a>' if rng.random() < 0.5 else f'{say(1, 6)} <a href="#">{say(1, 2)}</a>'
        tag = rng.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{item()}</li>" for _ in range(rng.randint(2, 5))) + f"</{tag}>"

    def comments() -> str:
        tag, inner = rng.choice(["div", "li", "article", "section"]), rng.choice(["b", "span", "h4", "cite"])
        item = lambda: f'<{tag} class="{words[3]}-{words[5]}" data-l="0"><{inner}>{say(1, 2)}</{inner}><p>{say(4, 60)}.</p>{rng.choice(["", "<a href=#>Reply</a>", "<span>2 days ago</span>"])}</{tag}>'
        title = rng.choice([f"<h3>{say(1, 3)}</h3>", "<h3>Comments (4)</h3>", "", "<h2>Responses</h2>"])
        outer = rng.choice(["div", "section", "ul" if tag == "li" else "div"])
        return f"<{outer}{name('comments', 0)}>{title}" + "".join(item() for _ in range(rng.randint(1, 6))) + f"</{outer}>"

    def off(kind: str) -> str:
        tag = rng.choice(["div", "section", "div"])
        plain = {
            "nav": lambda: f"<{tag}{name('nav', 0)}>{links(rng.randint(2, 8))}</{tag}>", "header": lambda: f"<div{name('header', 0)}><h2>{say(1, 4)}</h2></div>",
            "footer": lambda: f"<div{name('footer', 0)}>&copy; {say(2, 30)} {links(3)}</div>", "side": lambda: f"<div{name('side', 0)}><h3>{say(1, 3)}</h3><p>{say(4, 40)}.</p>{links(3)}</div>",
            "notice": lambda: f"<div{name('notice', 0)}><p>{say(5, 40)}.</p><button>{say(1, 1)}</button></div>", "ad": lambda: f"<div{name('ad', 0)}>{say(2, 30)}.</div>",
            "form": lambda: f"<div{name('form', 0)}><p>{say(4, 15)}.</p><input></div>", "comments": comments, "related": lambda: f"<div{name('related', 0)}>{links(4)}</div>",
        }
        tagged = {
            "nav": lambda: f'<nav data-l="0">{links(rng.randint(2, 8))}</nav>', "header": lambda: f'<header data-l="0"><a href="/">{say(1, 3)}</a><p>{say(2, 8)}</p></header>',
            "footer": lambda: f'<footer data-l="0"><p>&copy; {say(2, 12)}.</p></footer>', "side": lambda: f'<aside data-l="0"><h3>{say(1, 3)}</h3>{text(1)}{links(4)}</aside>',
            "form": lambda: f'<form data-l="0"><label>{say(1, 3)}</label><input><p>{say(3, 12)}.</p><button>{say(1, 2)}</button></form>',
        }
        return (tagged if semantic and kind in tagged and rng.random() < 0.9 else plain)[kind]()

    # an advert without a speaking name cannot be told from a short paragraph
    inside = ["related", "form", "side", "comments", *(["ad"] if speaks else [])]
    title = f"<h1>{say(2, 9)}</h1>"
    inner = [f'<header data-l="1">{title}<p>{say(2, 6)}</p></header>' if rng.random() < 0.15 else title, text(rng.choice((1, 2, 3, 5, 8, 40)))]
    if rng.random() < 0.4:
        inner.append(f"<h2>{say(1, 5)}</h2>{text(2)}")
    if rng.random() < 0.3:
        inner.append("<ul>" + "".join(f"<li>{say(2, 14)}</li>" for _ in range(4)) + "</ul>")
    if rng.random() < 0.3:
        inner.append(f"<blockquote>{say(5, 30)}.</blockquote><p>{say(3, 12)} <a href='#'>{say(1, 3)}</a> {say(3, 20)}.</p>")
    for piece in (table, definitions, figure, listing):
        if rng.random() < 0.15:
            inner.insert(rng.randint(1, len(inner)), piece())
    bare = rng.random() < 0.12  # without an element of its own around the article
    if bare:
        inner = [re.sub(r"<(h1|h2|p|ul|blockquote|table|dl|figure|pre)>", r'<\1 data-l="1">', x) for x in inner]
    for kind in inside:
        if rng.random() < (0.1 if bare else 0.3):
            inner.insert(rng.randint(1, len(inner)), off(kind))
    if rng.random() < 0.4 and not bare:
        inner[0] = f"<div><div>{inner[0]}</div></div>"
    holder = rng.choice(["article", "main", "article"] if semantic else ["div", "div", "section"])
    article = "".join(inner) if bare else f"<{holder}{name('content', 1)}>{''.join(inner)}</{holder}>"
    for _ in range(0 if bare else rng.choice((0, 0, 1, 1, 2))):
        article = f"<div{name('wrapper', 2)}>{article}{off('side') if rng.random() < 0.4 else ''}</div>"
    before = "".join(off(k) for k in ("notice", "header", "nav", "ad", "form", "related") if rng.random() < 0.45 and (k != "ad" or speaks))
    after = "".join(off(k) for k in ("related", "comments", "side", "ad", "form", "footer", "notice") if rng.random() < 0.45 and (k != "ad" or speaks))
    body = f' class="{" ".join(rng.sample(names["misleading"].split(), 2))}"' if rng.random() < 0.4 else ""
    if bare and rng.random() < 0.5:
        return article if rng.random() < 0.5 else before + article + after
    return f'<html data-l="2"><head><title>{say(1, 4)}</title></head><body{body} data-l="2">{before}{article}{after}</body></html>'


def fit(pages: list[str]) -> Potentials:
    """Softmax node potentials by gradient steps, edges by counting. pages: such as have an article element."""
    rng = random.Random(SEED)
    trees = [(t, labels_given(t)) for t in (tree_of(labelled_page(rng)) for _ in range(LAID_OUT))]
    trees += [(t, labels_by_article(t)) for t in map(tree_of, pages)]
    x, y = np.concatenate([features_of(t) for t, _ in trees]), np.concatenate([s for _, s in trees])
    edge, root = np.full((3, 3), 0.5), np.full(3, 0.5)
    edge[BOILERPLATE] = (0.5, 1e-4, 1e-4)  # nothing inside boilerplate is content
    for t, s in trees:
        root[s[0]] += 1
        for i in range(1, len(s)):
            edge[s[t.parent[i]], s[i]] += 1
    goal = np.eye(3)[y]
    w, speed = np.zeros((FEATURES, 3)), np.zeros((FEATURES, 3))
    for _ in range(400):
        p = x @ w
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + x.T @ (goal - p) / len(x) - 1e-5 * w
        w += 4.0 * speed
    starts = np.concatenate(([0], np.cumsum([len(s) for _, s in trees])[:-1]))
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + a) for (t, _), a in zip(trees, starts, strict=True)])
    depth = np.concatenate([t.depth for t, _ in trees])

    base = (w, np.log(goal.mean(axis=0)), np.log(root / root.sum()), np.log(edge / edge.sum(axis=1, keepdims=True)))
    tried = [Potentials(*base, leaf, element) for leaf in (0.03, 0.06, 0.12, 0.25, 0.5, 1.0) for element in (0.35, 0.6, 1.0)]
    return min(tried, key=lambda m: -float(np.log(marginals(x, parent, depth, m)[np.arange(len(y)), y] + 1e-9).sum()))


def extract(pages: DataFrame, model: Potentials, most_nodes: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks (left in), n_dropped for every row of pages (page_id, url, html).

    Null and empty pages have an empty text. Pages are worked on in groups of about most_nodes nodes; a page is never cut.
    """
    names = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64(), "n_blocks": pa.int64(), "n_dropped": pa.int64()}

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        trees = [r[2] for r in rows]
        sizes = [len(t.parent) for t in trees]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + s) for t, s in zip(trees, starts, strict=True)])
        found = marginals(np.concatenate([features_of(t) for t in trees]), parent, np.concatenate([t.depth for t in trees]), model)[:, CONTENT]
        out = []
        for (page_id, url, t), s in zip(rows, starts, strict=True):
            leaves = [i for i, x in enumerate(t.text) if x is not None]
            kept = [t.text[i] for i in leaves if found[s + i] >= 0.5 or len(t.parent) == len(leaves) + 1]  # plain text without an element
            text = "\n".join(kept)
            out.append((page_id, url, text, len(text), len(kept), len(leaves) - len(kept)))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), names.values(), strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, nodes = [], 0
            for page_id, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows.append((page_id, url, tree_of(page.as_py())))
                nodes += len(rows[-1][2].parent)
                if nodes >= most_nodes:
                    yield solve(rows)
                    rows, nodes = [], 0
            if rows:
                yield solve(rows)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_dropped long")


def main_text(pages: DataFrame) -> DataFrame:
    """extract() with potentials trained on laid-out pages and on marked pages of the table, chosen by a hash of their id."""
    marked = pages.where(F.lower("html").contains("<article"))
    # ids and lengths first, so that tasks send the driver numbers and not pages
    listed = marked.select(F.xxhash64("page_id").alias("h"), F.length("html").alias("n")).orderBy("h", "n").limit(MOST_LABELLED).collect()
    hashes, room = [], MOST_CHARACTERS
    for r in listed:
        if r.n <= room:
            hashes, room = [*hashes, r.h], room - r.n
    chosen = marked.where(F.xxhash64("page_id").isin(hashes) & (F.length("html") <= MOST_CHARACTERS)).select("html").orderBy("html").limit(MOST_LABELLED).collect() if hashes else []
    return extract(pages, fit([r.html for r in chosen]))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
