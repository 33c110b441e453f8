"""Main text of web pages by a minimum cut.

A page becomes blocks of text and the elements around them.  A linear classifier gives each
block (from its text and its own tag) and each element (from its tag and names) a cost for
either label, which becomes its capacity to one terminal.  Smoothness edges tie blocks that
follow each other, and each block and element to the element around it.  The maximum flow
separates content from boilerplate at the least total cost: a short line inside an article is
content though its own words don't say so, and long prose in a sidebar is not.

The border of an element that says it is no content ties nothing, so text beside a menu is
not drawn to it.  A page on which nothing leans far enough to content is cut again with all
that lies outside such elements leaning further: its text is not lost for being short.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, slices

# Elements by their part in a page.
UNSEEN = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "button", "select", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "li", "main", "menu", "nav",
    "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: Elements that a like one, or any of these, closes.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "head": {"body"}}
FRAME = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "search", "head"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
HINTS = {
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
GOOD_HINTS = {"article", "content", "entry", "main", "post", "story"}
#: Hints that hold for an article too, which is a reader's then.
READERS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
#: Words that say nothing by themselves beside a hint.
PLAIN_WORDS = {
    "area", "bar", "block", "bottom", "box", "buttons", "container", "group", "holder", "inner", "item", "items", "left", "links", "list", "outer", "page", "panel", "right", "row",
    "section", "site", "slot", "thread", "top", "unit", "wrap", "wrapper",
}

# The classifier.  A block: what its text and own tag add to its leaning towards content.
WEIGHTS = {"bias": -0.6, "words": 0.06, "most_words": 3.0, "sentence": 0.8, "paragraph": 0.8, "heading": 0.3, "links": -4.0}
# An element, for each block inside: a tag or role that says what it is, a name that does, a
# name that has such a word among others.
FRAMED, NAMED, SUGGESTED, MAINLY, GOOD_NAME = -6.0, -6.0, -1.5, 3.0, 1.0
# Smoothness: blocks that follow each other; what is tied to the element around it.  For each
# block that is tied, more: for main text to lose it, for what says boilerplate to hold content.
NEXT, TIED, HELD, ENCLOSED = 0.5, 0.8, 6.0, 8.0
#: What blocks outside marked elements gain, in turn, while a page has no content.
GAINS = (1.0, 2.0, 4.0)
#: Of all text, the share that a form with the page's title holds if it is the page's frame.
WHOLE = 0.5

_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"?+|'[^']*+'?+|[^\s>"'][^\s>]*+|(?=>)|\Z))?+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?+|</(?![a-zA-Z])[^>]*+>?+|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)>?+|[^<]++|<", re.S)
_NAMED = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>"'][^\s>]*+)))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """Text, its leaning by itself, and the node around it."""

    text: str
    leaning: float
    around: int


@dataclass
class Element:
    """``leaning`` for each block inside; ``marked`` if its tag or name says boilerplate,
    ``boxed`` if that or an element around it does."""

    tag: str
    around: int
    leaning: float = 0.0
    marked: bool = False
    boxed: bool = False
    main: bool = False
    quoted: bool = False
    titled: bool = False
    blocks: int = 0
    chars: int = 0


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def names_say(value: str) -> tuple[bool, bool, bool, bool]:
    """Of a class or id: whether a name says boilerplate, only suggests it, says content, or
    says that readers wrote it."""
    bad = maybe = good = readers = False
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        known = HINTS.intersection(words)
        if name.lower() in HINTS or known and all(w in HINTS or w in PLAIN_WORDS for w in words):
            bad = True
            readers |= bool(READERS.intersection(words))
        elif known:
            maybe = True
        good |= bool(GOOD_HINTS.intersection(words))
    return bad, maybe, good, readers


def opened(tag: str, attributes: str, around: int, outer: Element, boxed: bool) -> Element:
    """An element with the classifier's leaning; in a box an article is a comment or teaser."""
    e = Element(tag, around, main=outer.main or tag in MAIN, quoted=outer.quoted or tag == "blockquote")
    found: dict[str, str] = {}
    if attributes and not attributes.isspace():
        for name, a, b, c in _NAMED.findall(attributes):
            found.setdefault(name.lower(), unescape(a or b or c))
    role = found.get("role", "").strip().lower()
    bad = maybe = good = readers = False
    if tag not in ("body", "html"):
        for key in ("class", "id"):
            if key in found:
                x, y, z, r = names_say(found[key])
                bad, maybe, good, readers = bad or x, maybe or y, good or z, readers or r
    e.main |= role in MAIN
    if tag in MAIN or role in MAIN:
        e.leaning += MAINLY * (not boxed and not readers)
    elif good:
        e.leaning += GOOD_NAME
    framed = tag in FRAME and not (tag == "footer" and outer.quoted) or tag == "header" and not outer.main or role in ROLES and tag not in MAIN
    if framed or readers or bad and not (e.tag in MAIN and not outer.marked):
        e.leaning += FRAMED if framed else NAMED
        e.marked = True
    elif maybe:
        e.leaning = e.leaning + SUGGESTED if e.leaning != GOOD_NAME else 0.0
    return e


def parsed(html: str) -> Page:
    """Blocks in page order, without what is never seen, and the elements around them."""
    page = Page(elements=[Element("", -1)])
    stack = [0]
    boxes = [False]  # whether a marked element is on the stack so far
    open_tags: dict[str, int] = {}
    forms: list[int] = []  # places on the stack of forms without main text so far
    parts: list[str] = []
    linked = 0
    link = False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            tag, w = page.elements[stack[-1]].tag, WEIGHTS
            s = w["bias"] + min(w["most_words"], w["words"] * (text.count(" ") + 1)) + w["links"] * min(1.0, linked / len(text))
            s += w["sentence"] * (text[-1] in ".!?:;…»”\"'。！？") + w["paragraph"] * (tag in ("p", "blockquote", "pre")) + w["heading"] * (tag in HEADINGS)
            page.blocks.append(Block(text, s, stack[-1]))
        parts.clear()
        linked = 0

    def close(k: int) -> None:
        for i in stack[k:]:
            open_tags[page.elements[i].tag] -= 1
        del stack[k:], boxes[k:]
        while forms and forms[-1] >= k:
            forms.pop()

    at = 0
    while m := _TOKEN.match(html, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                parts.append(unescape(raw) if "&" in raw else raw)
                if link:
                    linked += len(parts[-1].strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = False
            elif tag in BLOCKS:
                if tag in ("body", "html"):
                    flush()
                    continue
                for k in range(len(stack) - 1, 0, -1) if open_tags.get(tag) or tag in ("p", "li") else ():
                    mine = page.elements[stack[k]].tag
                    if mine == tag:
                        flush()
                        close(k)
                        link = False
                        break
                    if tag in ("p", "li") and mine not in CLOSED_BY:
                        if tag == "p":
                            flush()  # an empty paragraph
                        break
            elif tag in ("td", "th"):
                parts.append(" ")
        elif tag in UNSEEN:
            if tag != "svg" or not m[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?+", re.I).search(html, at)
                at = end.end() if end else len(html)
        elif tag == "a":
            link = True
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        elif tag in BLOCKS or tag == "hr":
            flush()
            link = False
            while len(stack) > 1 and tag in CLOSED_BY.get(page.elements[stack[-1]].tag, ()):
                close(len(stack) - 1)
            if tag in VOID:
                continue
            if boxes[-1] and (tag in MAIN or tag == "h1"):
                _unframe(page, stack, boxes, forms, tag)
            page.elements.append(opened(tag, m[3], stack[-1], page.elements[stack[-1]], boxes[-1]))
            stack.append(len(page.elements) - 1)
            boxes.append(boxes[-1] or page.elements[-1].marked)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag == "form":
                forms.append(len(stack) - 1)
    flush()
    _whole_forms(page)
    return page


def _unframe(page: Page, stack: list[int], boxes: list[bool], forms: list[int], inside: str) -> None:
    """A form around main text frames the page, not a form; what holds the page's main
    element is no part of its frame whatever its name suggests."""
    if inside == "h1":
        for k in reversed(forms):
            if page.elements[stack[k]].titled:
                break  # so are those around it
            page.elements[stack[k]].titled = True
        return
    plain = forms[:]
    forms.clear()
    if inside == "main":
        plain += [k for k, i in enumerate(stack) if page.elements[i].marked and page.elements[i].tag in ("div", "section")]
    for k in plain:
        page.elements[stack[k]].leaning, page.elements[stack[k]].marked = 0.0, False
    for k in range(min(plain), len(stack)) if plain else ():
        boxes[k] = page.elements[stack[k]].marked or k > 0 and boxes[k - 1]


def _whole_forms(page: Page) -> None:
    """A form with a title frames the page if it holds most of its text."""
    if not any(e.titled for e in page.elements):
        return
    for b in page.blocks:
        page.elements[b.around].chars += len(b.text)
    for e in reversed(page.elements):
        if e.around >= 0:
            page.elements[e.around].chars += e.chars
    for e in page.elements:
        if e.titled and e.chars >= WHOLE * page.elements[0].chars:
            e.leaning, e.marked = 0.0, False


def graph(page: Page) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Leanings of blocks, then of elements, and arcs (i, j, cost): the cost where i is
    content and j is not.  An element that says nothing and holds one block is left out."""
    elements = page.elements
    for b in page.blocks:
        elements[b.around].blocks += 1
    box = list(range(len(elements)))  # the innermost marked element around, itself included
    for k, e in enumerate(elements):  # an element comes after the one around it
        e.boxed = e.marked or e.around >= 0 and elements[e.around].boxed
        if not e.marked:
            box[k] = box[e.around] if e.around >= 0 else 0
    for e in reversed(elements):
        if e.around >= 0:
            elements[e.around].blocks += e.blocks
    number: list[int] = []
    leaning = [b.leaning for b in page.blocks]
    arcs: list[tuple[int, int, float]] = []
    for i in range(1, len(page.blocks)):
        if box[page.blocks[i - 1].around] == box[page.blocks[i].around]:
            arcs += [(i - 1, i, NEXT), (i, i - 1, NEXT)]

    def tie(inner: int, around: int, blocks: int, marked: bool) -> None:
        e, outer = elements[around], number[around]
        if not marked:
            arcs.append((outer, inner, HELD * blocks if e.main else TIED))
        if e.boxed or not marked:
            arcs.append((inner, outer, ENCLOSED * blocks if e.boxed else TIED))

    for e in elements:
        if e.around < 0 or e.blocks > 1 or e.blocks and (e.leaning or e.marked):
            number.append(len(leaning))
            leaning.append(e.leaning * e.blocks)
            if e.around >= 0:
                tie(number[-1], e.around, e.blocks, e.marked)
        else:
            number.append(number[e.around])
    for i, b in enumerate(page.blocks):
        tie(i, b.around, 1, False)
    return leaning, arcs


def minimum_cut(leaning: list[float], arcs: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise what leanings and arcs cost; of equal cuts the one with the
    fewest nodes of content.

    A node that leans further than its own arcs can ever cost keeps its side in every minimum
    cut, so it is settled first; the maximum flow decides all others.
    """
    n = len(leaning)
    lean = list(leaning)
    out, into = [0.0] * n, [0.0] * n
    for i, j, c in arcs:
        out[i] += c
        into[j] += c
    label = [True if s > o else False if -s > t else None for s, o, t in zip(lean, out, into)]
    room: dict[int, dict[int, float]] = {i: {} for i in range(n) if label[i] is None}
    for i, j, c in arcs:
        if label[i] is None and label[j] is None:
            room[i][j] = room[i].get(j, 0.0) + c
            room[j].setdefault(i, 0.0)
        elif label[j] is None and label[i]:
            lean[j] += c
        elif label[i] is None and label[j] is False:
            lean[i] -= c
    if room:
        content = _reached(room, lean)
        for i in list(room):
            if i >= 0:
                label[i] = i in content
    return label


def _reached(room: dict[int, dict[int, float]], lean: list[float]) -> set[int]:
    """Nodes on the source's side after a maximum flow (levels and blocking flows)."""
    source, sink = -1, -2
    nodes = list(room)
    room[source], room[sink] = {}, {}
    for i in nodes:
        if lean[i] > 0:
            room[source][i], room[i][source] = lean[i], 0.0
        elif lean[i] < 0:
            room[i][sink], room[sink][i] = -lean[i], 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            if u == sink:
                break
            for v, c in room[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level) - {source}
        ways = {u: [v for v in room[u] if level.get(v) == level[u] + 1] for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(room[a][b] for a, b in zip(path, path[1:]))
                cut = None
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    room[a][b] -= push
                    room[b][a] += push
                    if cut is None and room[a][b] <= 1e-12:
                        cut = k
                del path[cut + 1 :]
                continue
            onward = ways[u]
            while onward and room[u][onward[-1]] <= 1e-12:  # full for the rest of this round
                onward.pop()
            if onward:
                path.append(onward[-1])
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()


def labelled(html: str | None) -> tuple[list[Block], list[bool]]:
    """A page's blocks and whether the cut calls each of them content."""
    page = parsed(html or "")
    if not page.blocks:
        return [], []
    leaning, arcs = graph(page)
    keep = minimum_cut(leaning, arcs)[: len(page.blocks)]
    free = [i for i, b in enumerate(page.blocks) if not page.elements[b.around].boxed]
    for gain in GAINS if free else ():
        if any(keep):
            break
        raised = list(leaning)
        for i in free:
            raised[i] += gain
        keep = minimum_cut(raised, arcs)[: len(page.blocks)]
    return page.blocks, keep


def main_text(html: str | None) -> str:
    """Blocks of content, joined by line ends; empty if there are none."""
    return "\n".join(b.text for b, k in zip(*labelled(html)) if k)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_blocks, n_changed) for each row of ``pages``: n_changed
    counts blocks whose own leaning the cut overruled.  Null and empty pages give an empty
    text, repeated rows a row each; ids that are no numbers are null.  Other columns are not
    read."""
    names = ["_id", "_url", "text", "n_chars", "n_blocks", "n_changed"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_html"):
            found = [labelled(h) for h in b.column("_html").to_pylist()]
            texts = ["\n".join(x.text for x, k in zip(*f) if k) for f in found]
            changed = [sum((x.leaning > 0) != k for x, k in zip(*f)) for f in found]
            columns = [pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (map(len, texts), [len(f[0]) for f in found], changed))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_url"), *columns], names=names)

    rows = pages.select(row_id(pages, id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).alias("_html"))
    found = rows.mapInArrow(work, "_id long, _url string, text string, n_chars long, n_blocks long, n_changed long")
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), *names[2:])
