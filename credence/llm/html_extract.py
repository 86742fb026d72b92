"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line's weight is the length of its text, or
zero where its surroundings say that it is no article text (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) or where most of it is links. Over the weights runs a sliding window of
``WINDOW`` lines: text surges where a window reaches the threshold, and dives where a window has fallen to
zero.

Where the page marks an article, the lines of its containers are the lines looked at; of several kinds of
marks the one whose containers hold most text counts. What a writer put there is text from the start, so it
dives only at a whole window without weight, that is at ``WINDOW`` lines of links or more, all of which go,
and surges again at the next line with weight; a lone line of links stays, and so does a run of them that a
heading leads, such as a list of sources. A container without any weight is kept whole. On other pages the threshold is ``SURGE`` characters or half of the largest window, whichever
is less, and since regions are parted by lines without weight alone, all lines from the first surge to the last line
with weight are kept, short ones too, but for what is no article text and for whole windows of links.

A form is no article text unless it holds the article: a mark of one, or most of the page's text.

Classes of <html>, <body> and <main> drop nothing, nor do those that tell of a layout ("has-sidebar") or in
which a word that could name a sidebar or the like stands beside words of another sense ("social-science").
Ids of headings are anchors and drop nothing, nor do those of sections within an article but for what names readers'
comments, related texts and the like.
Where all lines of a page weigh nothing by their surroundings, it is read again without regard to class words.

A null or empty page has the empty text. Repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"([a-z])([A-Z])")

# Elements of the HTML standard by what they mean for the text.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_GONE = _RAW | {"noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "datalist", "head"}
_ASIDE = {"nav", "header", "footer", "aside", "menu", "dialog", "fieldset"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input",
    "ins", "kbd", "label", "link", "mark", "meta", "meter", "nobr", "output", "picture", "progress", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "time", "track", "tt", "u", "var", "wbr", "br",
}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: Words of a class, id or role that name something else than the article.
_ASIDE_WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "advertising", "adbox", "adslot", "sponsor", "sponsored", "promo", "promotion",
    "banner", "sidebar", "aside", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead",
    "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "teaser", "teasers", "widget", "widgets",
    "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "pagination", "pager", "toolbar", "copyright", "legal",
    "complementary", "contentinfo", "search", "dialog", "tags", "skip", "sitenav", "topbar", "disclaimer", "paywall", "outbrain", "taboola",
}
#: The same, where they stand for the page's head only outside an article.
_HEAD_WORDS = {"header", "head", "top", "meta", "byline", "toc"}
#: Words that tell of a part's shape or place and leave the sense of the word beside them as it is.
_SHAPE_WORDS = {
    "area", "bar", "bars", "bg", "block", "blocks", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "center", "col", "column",
    "container", "content", "fixed", "form", "frame", "global", "grid", "group", "holder", "icon", "icons", "inner", "item", "items", "js", "large", "left", "link",
    "links", "list", "main", "mobile", "outer", "page", "pane", "panel", "post", "posts", "article", "articles", "primary", "right", "row", "secondary", "section", "site", "slot",
    "small", "stories", "sticky", "text", "title", "top", "unit", "view", "widget", "wrap", "wrapper", "zone", "header", "head", "meta", "media", "page", "user", "story", "thread",
}
#: Words of the ids of sections within an article that name something else than a part of it.
_PART_WORDS = {
    "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "related", "recommended", "recommendations", "newsletter", "signup", "subscribe", "share", "sharing",
    "sidebar", "sponsor", "sponsored", "outbrain", "taboola", "paywall",
}
#: Elements that hold the page or its main part, whatever their classes say of the rest.
_HOLDERS = {"html", "body", "main"}
#: Words beside which one of the above tells of the page's layout and names nothing.
_LAYOUT_WORDS = {"has", "have", "no", "with", "without", "open", "closed", "enabled", "disabled"}
#: Words of a class, id or role that name the article, the strongest first.
_MAIN_WORDS = ({"articlebody"}, {"article", "post", "story", "entry"}, {"main", "content", "maincontent", "body"})


def _aside(tag: str, attrs: str, in_main: bool, named: bool = True) -> tuple[bool, int]:
    """Whether an element is no article text; the strength with which it marks an article, 0 to 5.

    Unless ``named``, classes, ids and roles make nothing something else than the article.
    """
    strength = {"article": 5, "main": 4}.get(tag, 0)
    aside = tag in _ASIDE and not (tag == "header" and in_main)
    if attrs:
        names: set[str] = set()
        others: set[str] = set()
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" and value != "until-found" or name == "aria-hidden" and value.lower() == "true":
                return True, 0
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    return True, 0
            elif name == "itemprop" and value.lower() == "articlebody":
                strength = max(strength, 5)
            elif name == "role" and value.lower() in ("main", "article"):
                strength = max(strength, 4)
            elif name not in ("hidden", "aria-hidden"):
                if name == "id" and tag in _HEADINGS:
                    continue
                for token in value.split():
                    words = set(_WORDS.findall(_CAMEL.sub(r"\1 \2", token).lower()))
                    names |= words
                    # An article is a comment or teaser only where a class says just that.
                    if words & _LAYOUT_WORDS or tag == "article" and len(words) > 1:
                        continue
                    if name == "id" and tag == "section" and in_main and not words & _PART_WORDS:
                        continue
                    if all(w in _ASIDE_WORDS or w in _SHAPE_WORDS or w in _HEAD_WORDS or w.isdigit() or len(w) < 3 for w in words):
                        others |= words
        if named and tag not in _HOLDERS and (others & _ASIDE_WORDS or not in_main and names & _HEAD_WORDS and tag != "article"):
            return True, 0
        if not strength and tag in ("div", "section", "td"):
            strength = next((3 - k for k, words in enumerate(_MAIN_WORDS) if names & words), 0)
    return aside, 0 if aside else strength


Line = tuple[str, bool, frozenset[int], float, bool]


def lines(html: str, named: bool = True) -> list[Line]:
    """(text, aside, strengths of the article marks around it, share of its text in links, whether it is a heading) of each block."""
    out: list[Line] = []
    #: Of each form whether it holds an article's mark; the forms around each line.
    holds: list[bool] = []
    around: list[tuple[int, ...]] = []
    forms: tuple[int, ...] = ()
    heading = False
    stack: list[tuple[str, bool, bool, int, int]] = []  # tag, gone, aside, strength, number of the form or -1
    gone = aside = False
    strength = links = linked = 0
    marks: frozenset[int] = frozenset()
    parts: list[str] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, aside, marks, min(1.0, linked / len(text)), heading))
                around.append(forms)
            parts.clear()
        linked = 0

    def state() -> None:
        nonlocal gone, aside, strength, links, marks, forms, heading
        gone, aside = any(x[1] for x in stack), any(x[2] for x in stack)
        marks = frozenset(x[3] for x in stack if x[3])
        strength = max(marks, default=0)
        links = sum(x[0] == "a" for x in stack)
        forms, heading = tuple(x[4] for x in stack if x[4] >= 0), any(x[0] in _HEADINGS for x in stack)

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else end]
        if text and not gone:
            parts.append(text)
            linked += len(text.strip()) if links else 0
        if not m:
            break
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        block = tag not in _INLINE
        if closing:
            known = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            # An inline end tag closes nothing beyond the block that it stands in.
            if known >= 0 and (block or all(x[0] in _INLINE for x in stack[known:])):
                if block or any(x[0] not in _INLINE for x in stack[known:]):
                    flush()
                if stack[known][1] and not block:
                    flush()
                del stack[known:]
                state()
            elif block:
                flush()
            continue
        if block:
            flush()
            if tag in _CLOSES_P and any(x[0] == "p" for x in stack):
                p = max(k for k, x in enumerate(stack) if x[0] == "p")
                if all(x[0] in _INLINE for x in stack[p + 1 :]):
                    del stack[p:]
                    state()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
                state()
        if tag in _VOID or attrs.rstrip().endswith("/") and not block:
            continue
        if tag in _RAW:
            # Raw text lasts up to its own end tag, whatever stands in it.
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag in ("body", "article", "main") and gone and any(x[0] == "head" for x in stack):
            del stack[next(k for k, x in enumerate(stack) if x[0] == "head") :]
            state()
        is_aside, mark = _aside(tag, attrs, strength >= 3, named)
        if tag == "form":
            holds.append(False)
        if mark >= 3:
            for k in forms:
                holds[k] = True
        new = (tag, tag in _GONE, is_aside, mark, len(holds) - 1 if tag == "form" else -1)
        if not block and (is_aside or new[1]):
            flush()
        stack.append(new)
        gone, aside, heading = gone or new[1], aside or is_aside, heading or tag in _HEADINGS
        if tag == "form":
            forms = (*forms, new[4])
        if mark and mark not in marks:
            marks, strength = marks | {mark}, max(strength, mark)
        links += tag == "a"
    flush()
    mass = [sum(len(x[0]) for x, f in zip(out, around, strict=True) if k in f and not x[1]) for k in range(len(holds))]
    whole = sum(len(x[0]) for x in out if not x[1])
    held = {k for k in range(len(holds)) if holds[k] or 2 * mass[k] > whole}
    return [x if set(f) <= held else (x[0], True, *x[2:]) for x, f in zip(out, around, strict=True)]


def regions(weights: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) of the sliding windows over the lines' weights."""
    w = np.array(weights, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(w)])
    ends = np.minimum(np.arange(len(w)) + window, len(w))
    sums = total[ends] - total[:-1]
    out: list[tuple[int, int]] = []
    surge = -1
    for i in range(len(w)):
        if surge < 0 and w[i] and sums[i] >= threshold:
            surge = i
        elif surge >= 0 and not sums[i]:
            out.append((surge, i))
            surge = -1
    if surge >= 0:
        out.append((surge, len(w)))
    return out


def dives(weights: list[int], window: int = WINDOW) -> list[bool]:
    """Whether each line lies in a whole window without weight; none does where nothing has weight."""
    w = np.array(weights, dtype=np.int64)
    out = np.zeros(len(w), dtype=bool)
    if w.any() and len(w) >= window:
        total = np.concatenate([[0], np.cumsum(w)])
        for i in np.flatnonzero(total[window:] == total[:-window]).tolist():
            out[i : i + window] = True
    return out.tolist()


def extract(html: str | None) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    if not html:
        return ""
    return _text(lines(html)) or _text(lines(html, named=False))


def _marked(found: list[Line]) -> list[bool]:
    """Which lines stand in the article's containers; none where nothing is marked.

    The mark whose containers hold most text, of equal ones the strongest; inside it a stronger mark whose
    containers hold at least half of that text.
    """
    mass: dict[int, int] = {}
    for t, aside, marks, *_ in found:
        for s in marks if not aside else ():
            mass[s] = mass.get(s, 0) + len(t)
    if not mass:
        return [False] * len(found)
    most = max(mass, key=lambda s: (mass[s], s))
    inside = {s: sum(len(t) for t, aside, marks, *_ in found if not aside and {s, most} <= marks) for s in mass}
    best = max(s for s in mass if s >= most and 2 * inside[s] >= mass[most])
    return [not aside and {most, best} <= marks for _, aside, marks, *_ in found]


def _links_go(found: list[Line]) -> list[bool]:
    """Which lines are links in whole windows of them that no heading leads."""
    gone = dives([len(x[0]) if x[3] <= 0.5 else 0 for x in found])
    for i, x in enumerate(found):
        led = i and (found[i - 1][4] and not gone[i - 1] or i > 1 and gone[i] and not gone[i - 1] and found[i - 1][3] > 0.5)
        if gone[i] and led:
            gone[i] = False
    return gone


def _text(found: list[Line]) -> str:
    marked = _marked(found)
    if any(marked):
        own = [x for x, m in zip(found, marked, strict=True) if m]
        return "\n\n".join(x[0] for x, g in zip(own, _links_go(own), strict=True) if not g)
    weights = [len(x[0]) if not x[1] and x[3] <= 0.5 else 0 for x in found]
    if not any(weights):
        return ""
    largest = max(sum(weights[i : i + WINDOW]) for i in range(len(weights)))
    # Only lines without weight part the regions: what follows the first surge is one article.
    first = regions(weights, max(1, min(SURGE, largest // 2)))[0][0]
    own = [x for x in found[first : max(i for i, w in enumerate(weights) if w) + 1] if not x[1]]
    return "\n\n".join(x[0] for x, g in zip(own, _links_go(own), strict=True) if not g)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
