"""Main text of web pages by two passes of block rules.

A small tokenizer splits the markup into blocks at block-level tags, keeps for each its text, its share
of link text and where it stands, and skips scripts, styles and the like. Elements whose tag or name says that
they are no part of a text (menus, notices, comments and so on) are excluded sections.

Pass one decides blocks by their length, link density and stop-word density: blocks of links are bad; long
blocks with many stop words are good, and long ones without are bad. Where a block stands moves the bounds: inside
an article or main element fewer stop words will do, on a page that has such an element only long prose counts
elsewhere. Excluded sections are bad. Pass two: each block still open takes the label of its nearest decided
neighbour, the better one of a tie; inside an article it is bad only if the nearest ones on both sides
are, and excluded sections there are no neighbours.

Null and empty pages, and pages without a good block, give an empty text. Repeated rows are kept, extra columns
ignored. Texts are never cut; unclosed tags end with the page. Time grows with the page's length.
"""

from __future__ import annotations

import functools
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow

#: Elements by their role.
SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "head", "title", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "option"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp"}
BOILERPLATE = {"nav", "footer", "aside", "form", "header", "menu", "dialog"}
CONTENT = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "script", "small", "span", "strike", "strong", "style", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Words in class, id or role that mark an element as boilerplate.
MARKS = "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead share sharing social related recommended comment comments disqus reply replies respond form search copyright disclaimer legal toolbar complementary contentinfo".split()
#: Beginnings that mark in the same way, and words that mark the text itself.
MARK_STARTS = ("comment", "advert", "cookie", "sidebar", "sponsor", "newsletter", "breadcrumb")
CONTENT_MARKS = {"article", "articlebody", "main", "maincontent", "post", "entry", "story"}
#: Frequent short words of the supported languages.
STOP_WORDS = """
the of and to in is that for it was on are as with be by this at from or an have not but they which you were his her their we been has had will would there what all
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch
el la de que y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy
le les et à il être un une en que pour dans ce son sur avec pas plus par je se ne qui au du est sont nous vous mais ou si leur y dont aux cette des ont été
""".split()  # noqa: SIM905

STOP_LOW, STOP_HIGH = 0.1, 0.2
LINKS_BAD, LENGTH_SHORT, LENGTH_LONG = 0.5, 70, 200
GOOD, BAD, OPEN = 1, 0, -1

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_ATTRS = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-z]+")


@functools.cache
def stop_words() -> frozenset[str]:
    return frozenset(STOP_WORDS)


class Block:
    __slots__ = ("bad", "container", "linked", "parts")

    def __init__(self, container: int, bad: bool):
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.container, self.bad = container, bad


class Open:
    """The open elements, each with the state before it; elements are found by name or as blocks without a search."""

    def __init__(self):
        self.stack: list[tuple[str, tuple]] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []  # places of elements that aren't inline

    def push(self, tag: str, state: tuple) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append((tag, state))

    def last(self, tag: str) -> int | None:
        found = self.places.get(tag)
        return found[-1] if found else None

    def pop(self, to: int) -> tuple:
        """Closes the element at a place and all inside it; the state before it."""
        state = self.stack[to][1]
        while len(self.stack) > to:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
        while self.solid and self.solid[-1] >= to:
            self.solid.pop()
        return state

    def ended_by(self, same: tuple[str, ...]) -> int | None:
        """The place of one of these elements that only inline elements and paragraphs lie in."""
        for at in reversed(self.solid):
            if self.stack[at][0] in same:
                return at
            if self.stack[at][0] != "p":
                return None
        return None


#: What a list item, cell and so on ends; other blocks end a paragraph.
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}


def _marked(attrs: str) -> int:
    """BAD if class, id or role has a boilerplate word or the element is hidden, GOOD for a word of the text itself, else OPEN."""
    out = OPEN
    for name, *values in _ATTRS.findall(attrs):
        name = name.lower()
        value = "".join(values)
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            words = _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            if any(w in _marks() or w.startswith(MARK_STARTS) for w in words):
                return BAD
            if name != "aria-label" and not CONTENT_MARKS.isdisjoint(words):
                out = GOOD
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return BAD
    return out


@functools.cache
def _marks() -> frozenset[str]:
    return frozenset(MARKS)


def blocks(html: str) -> list[Block]:
    """The page's blocks with some text. container: number of the nearest article or main element, 0 outside."""
    out: list[Block] = []
    elements = Open()
    bad = skipped = link = False
    container = containers = 0
    now = Block(0, False)

    def close() -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block(container, bad)

    at, n = 0, len(html)
    while at < n:
        found = _TAG.search(html, at)
        start = found.start() if found else n
        if start > at and not skipped:
            now.parts.append(html[at:start])
            if link:
                now.linked.append(html[at:start])
        if not found:
            break
        comment, declaration, closing, tag = found.groups()
        if comment:
            end = html.find("-->", found.end())
            at = n if end < 0 else end + 3
            continue
        stop = _END.match(html, found.end())
        at = stop.end() if stop else (html.find(">", found.end()) + 1 or n)
        if declaration:
            continue
        tag = tag.lower()
        if closing:
            where = elements.last(tag)
            if where is None:
                if tag in ("p", "br"):
                    close()
            elif tag in INLINE and elements.solid and elements.solid[-1] > where:
                link = link and tag != "a"  # a misnested inline end doesn't close blocks
            else:
                was = bad
                bad, skipped, container, link = elements.pop(where)
                if tag not in INLINE or bad != was:
                    close()
            continue
        attrs = html[found.end() : at - 1]
        if tag not in INLINE:
            if tag in ENDS_PARAGRAPH or tag in SAME or tag == "option":
                where = elements.ended_by(SAME.get(tag, ("p",)))
                if where is not None:
                    bad, skipped, container, link = elements.pop(where)
            close()
        if tag in VOID or attrs.endswith("/") and tag in ("path", "circle", "rect"):
            continue
        elements.push(tag, (bad, skipped, container, link))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = end.start() if end else n
            skipped = True
            continue
        mark = _marked(attrs) if attrs.strip() and tag not in ("html", "body") else OPEN
        apart = mark == BAD and not bad and tag in INLINE
        if apart:  # an inline notice or advert is a block of its own
            close()
        bad = bad or tag in BOILERPLATE or mark == BAD and (tag not in CONTENT or containers > 0)
        if not bad and not container and (tag in CONTENT or mark == GOOD and tag in ("div", "section", "td")):
            containers += 1
            container = containers
        if tag in SKIPPED:
            skipped = True
        if tag == "body":
            skipped = False
        link = link or tag == "a"
        if tag not in INLINE or apart:
            now = Block(container, bad)
    close()
    return out


#: Places of blocks: on a page that names no article, inside an article, outside of the page's articles.
PLAIN, INSIDE, OUTSIDE = range(3)


def decided(length: int, links: float, stops: float, place: int, excluded: bool) -> int:
    """Pass one, from the block's length, link density, stop-word density and place."""
    if excluded or links > LINKS_BAD:
        return BAD
    if place == OUTSIDE:
        return GOOD if length >= LENGTH_LONG and stops >= STOP_HIGH else BAD
    if length < LENGTH_SHORT:
        return OPEN
    if place == INSIDE:
        return GOOD if stops >= STOP_LOW or length >= LENGTH_LONG else OPEN
    if stops >= STOP_HIGH or stops >= STOP_LOW and length >= LENGTH_LONG:
        return GOOD
    return BAD if stops < STOP_LOW else OPEN


def inherited(labels: list[int], containers: list[int], excluded: list[bool]) -> list[int]:
    """Pass two: labels with every open one taken from its nearest decided neighbours in the same container."""
    n = len(labels)
    nearest = []
    for order, step in ((range(n), -1), (range(n - 1, -1, -1), 1)):
        near = [(n + 1, OPEN)] * n
        for i in order:
            j = i + step
            if labels[i] != OPEN:
                near[i] = (0, labels[i])
            elif 0 <= j < n and containers[j] == containers[i] and not (containers[j] and excluded[j]):
                near[i] = (near[j][0] + 1, near[j][1])
        nearest.append(near)
    out = []
    for i, label in enumerate(labels):
        if label == OPEN:
            sides = [x[i] for x in nearest if x[i][1] != OPEN]
            if containers[i]:
                label = BAD if [x for _, x in sides] == [BAD, BAD] else GOOD
            else:
                least = min((d for d, _ in sides), default=0)
                label = max((x for d, x in sides if d == least), default=BAD)
        out.append(label)
    return out


def main_text(html: str | None) -> str:
    """The good blocks' texts in page order, white space inside collapsed, joined by spaces."""
    if not html:
        return ""
    texts, found, measures = [], [], []
    for b in blocks(html):
        if text := " ".join(unescape("".join(b.parts)).split()):
            words = _WORD.findall(text.lower())
            linked = len(" ".join(unescape("".join(b.linked)).split())) / len(text) if b.linked else 0.0
            texts.append(text)
            found.append(b)
            measures.append((len(text), linked, sum(map(stop_words().__contains__, words)) / len(words) if words else 0.0))
    named = any(b.container and not b.bad for b in found)
    labels = [decided(*m, INSIDE if b.container else OUTSIDE if named else PLAIN, b.bad) for m, b in zip(measures, found)]
    kept = inherited(labels, [b.container for b in found], [b.bad for b in found])
    return " ".join(t for t, label in zip(texts, kept) if label == GOOD)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row."""
    schema = T.StructType([df.schema[key], df.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def step(rows: dict) -> dict:
        texts = list(map(main_text, rows[html]))
        return {key: rows[key], url: rows[url], "text": texts, "n_chars": list(map(len, texts))}

    return map_arrow(df.select(key, url, html), step, schema, html)
