"""Operator 6: main text of web pages from flat text blocks.

A page is cut at block-level tags into flat text blocks. A decision tree,
fitted to the small labelled table below, says which of them are main text:
from word count and link density of the block and its two neighbours, and from
what is known of its place: whether it is a heading, stands in an article, in
an element that is no text of the page by its tag or name (navigation, footer,
form, comments ...), or outside of the article that holds the page's text, and
whether it reads like a notice (copyright, log in ...).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Tags that end a text block; content of SKIP is never text; VOID have none.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul video".split())
SKIP = frozenset("script style noscript template iframe object textarea canvas title".split())
HIDE = frozenset("head svg".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ITEMS = frozenset("p li dt dd tr td th option".split())
HOLDERS = frozenset("ul ol dl table article main div section nav aside footer header form blockquote".split())
#: Elements that are no text of the page: by tag, or by a class, id or role whose parts are all in ASIDE_PARTS or OTHER_PARTS, one at least in the first.
ASIDE_TAGS = frozenset("nav header footer aside form menu button select dialog fieldset".split())
ASIDE_PARTS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement banner breadcrumb breadcrumbs cc comment commentlist comments complementary contentinfo cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "pager pagination popup promo promotion related replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
OTHER_PARTS = frozenset("area article bar block bottom box buttons container global google group inner item items left links list main outer page post posts primary reader right secondary section side site slot thread top unit user window wrap wrapper".split())
#: Elements that hold the page's text: by tag, or a div or section by one of its names, if LEAST of the words are in them.
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article main post entry story content article-body article-content content-body entry-content main-content post-body post-content story-body".split())
LEAST, MOST = 0.3, 0.6
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_QUOTE = re.compile("[\"'>]")
_NOTICE = re.compile(r"^(?:\u00a9|\(c\)|copyright\b|(?:log|sign) (?:in|up)\b)|all rights reserved|\bcookies?\b.*\b(?:accept|consent|policy)\b|\b(?:accept|consent|policy)\b.*\bcookies?\b", re.I)

FEATURES = ("words", "link_density", "before_words", "before_density", "after_words", "after_density", "heading", "in_article", "aside", "outside", "notice")
#: Labelled blocks, by hand: the first eight features in this order, and 1 for main text; the others are 0.
_PLAIN = (
    # Pages without an article element: paragraphs.
    (80, 0, 50, 0, 60, 0, 0, 0, 1), (45, 0.02, 6, 0, 70, 0, 0, 0, 1), (20, 0, 60, 0, 40, 0, 0, 0, 1), (120, 0.05, 80, 0, 4, 1, 0, 0, 1), (60, 0, 3, 1, 4, 1, 0, 0, 1), (35, 0.1, 30, 0, 50, 0, 0, 0, 1),
    (40, 0.1, 4, 1, 5, 1, 0, 0, 1), (25, 0.2, 30, 0, 30, 0, 0, 0, 1), (18, 0.3, 25, 0, 20, 0, 0, 0, 1), (200, 0, 7, 0, 6, 0, 0, 0, 1), (28, 0, 2, 1, 90, 0, 0, 0, 1), (55, 0, 70, 0, 8, 0, 0, 0, 1), (40, 0, 6, 1, 0, 0, 0, 0, 1), (90, 0, 2, 1, 3, 0, 0, 0, 1),
    # Short ones between paragraphs or at the end of the text, headings, and pages of few words.
    (5, 0, 40, 0, 40, 0, 0, 0, 1), (3, 0, 60, 0, 55, 0, 0, 0, 1), (8, 0, 45, 0, 20, 0, 0, 0, 1), (1, 0, 30, 0, 80, 0, 0, 0, 1), (6, 0, 50, 0, 18, 0, 0, 0, 1), (5, 0, 60, 0, 0, 0, 0, 0, 1),
    (7, 0, 2, 1, 60, 0, 1, 0, 1), (5, 0, 3, 1, 80, 0, 1, 0, 1), (4, 0, 70, 0, 45, 0, 1, 0, 1), (9, 0, 0, 0, 30, 0, 1, 0, 1), (3, 1, 60, 0, 50, 0, 0, 0, 1), (6, 0.8, 40, 0, 50, 0, 0, 0, 1),
    (12, 0, 0, 0, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 0, 0, 0, 1), (4, 0, 0, 0, 6, 0, 0, 0, 1), (6, 0, 4, 0, 0, 0, 0, 0, 1), (5, 0, 6, 0, 7, 0, 0, 0, 1), (7, 0, 5, 0, 30, 0, 0, 0, 1),
    # Menus, link lists, lines between links, and what stands at the end of a page.
    (1, 1, 0, 0, 1, 1, 0, 0, 0), (1, 1, 1, 1, 12, 0, 0, 0, 0), (2, 1, 2, 1, 2, 1, 0, 0, 0), (6, 0.9, 4, 1, 3, 1, 0, 0, 0), (10, 0.8, 50, 0, 4, 1, 0, 0, 0), (4, 1, 40, 0, 3, 1, 0, 0, 0),
    (1, 1, 1, 1, 60, 0, 0, 0, 0), (8, 0.75, 1, 1, 6, 0.9, 0, 0, 0), (30, 0.6, 20, 0.7, 20, 0.6, 0, 0, 0), (12, 0.9, 60, 0, 4, 1, 0, 0, 0), (9, 0.6, 30, 0, 8, 0.6, 0, 0, 0), (6, 1, 9, 1, 0, 0, 0, 0, 0),
    (4, 0, 1, 1, 2, 1, 0, 0, 0), (3, 0, 2, 1, 3, 1, 0, 0, 0), (8, 0, 3, 1, 0, 0, 0, 0, 0), (10, 0, 4, 1, 0, 0, 0, 0, 0), (6, 0, 5, 0.9, 4, 0.8, 0, 0, 0), (2, 0, 3, 1, 4, 1, 1, 0, 0),
    # Within an article: all but runs of links.
    (60, 0, 40, 0, 55, 0, 0, 1, 1), (9, 0, 5, 0, 80, 0, 1, 1, 1), (1, 0, 60, 0, 30, 0, 0, 1, 1), (5, 0, 60, 0, 12, 0.2, 0, 1, 1), (3, 0, 1, 1, 90, 0, 1, 1, 1), (2, 0, 1, 1, 12, 0, 0, 1, 1),
    (25, 0.2, 30, 0, 30, 0, 0, 1, 1), (6, 0, 0, 0, 0, 0, 0, 1, 1), (14, 0, 1, 1, 9, 0, 0, 1, 1), (4, 0, 1, 1, 3, 1, 0, 1, 1), (1, 0, 0, 0, 0, 0, 0, 1, 1), (8, 0, 40, 0, 3, 1, 0, 1, 1),
    (3, 1, 40, 0, 30, 0, 0, 1, 1), (6, 0.8, 20, 0.1, 50, 0, 0, 1, 1), (2, 1, 25, 0, 20, 0, 0, 1, 1), (18, 0.5, 25, 0, 20, 0, 0, 1, 1), (2, 1, 30, 0, 0, 0, 0, 1, 1), (1, 0, 2, 1, 2, 1, 0, 1, 1),
    (6, 0.7, 9, 0, 10, 0, 0, 1, 1), (2, 1, 8, 0, 7, 0, 0, 1, 1), (4, 1, 70, 0, 60, 0, 0, 1, 1), (5, 0.8, 3, 0, 0, 0, 0, 1, 1), (3, 1, 0, 0, 40, 0, 0, 1, 1), (5, 0.6, 4, 0, 0, 0, 0, 1, 1),
    (3, 0.7, 0, 0, 6, 0.8, 0, 1, 1), (8, 0.6, 20, 0, 9, 0.7, 0, 1, 1), (10, 0.7, 9, 0.6, 12, 0.5, 0, 1, 1), (4, 0.75, 6, 0.6, 5, 0.8, 0, 1, 1), (6, 0.8, 5, 0.7, 40, 0, 0, 1, 1),
    (1, 0, 90, 0, 0, 0, 0, 1, 1), (2, 0, 150, 0, 30, 0, 0, 1, 1), (1, 0, 200, 0, 250, 0, 0, 1, 1), (300, 0, 1, 0, 2, 0, 0, 1, 1), (3, 0, 4, 1, 3, 1, 0, 1, 1), (12, 0, 2, 1, 2, 1, 0, 1, 1),
    (20, 0, 3, 1, 0, 0, 0, 1, 1), (8, 0, 4, 1, 2, 0, 0, 1, 1), (40, 0, 6, 1, 0, 0, 0, 1, 1), (3, 0, 1, 1, 0, 0, 0, 1, 1), (60, 0, 5, 1, 4, 0, 0, 1, 1), (2, 0, 1, 1, 4, 0, 1, 1, 1),
    (7, 0, 5, 1, 0, 0, 0, 1, 1), (10, 0, 4, 1, 0, 0, 0, 1, 1), (12, 0, 3, 1, 0, 0, 0, 1, 1), (14, 0, 2, 1, 0, 0, 0, 1, 1),
    (3, 1, 3, 1, 4, 1, 0, 1, 0), (5, 1, 60, 0, 4, 1, 0, 1, 0), (4, 1, 3, 1, 12, 0, 0, 1, 0), (6, 1, 5, 1, 30, 0, 0, 1, 0), (2, 1, 2, 1, 2, 1, 0, 1, 0), (7, 0.9, 6, 1, 5, 1, 0, 1, 0),
)
#: Labelled blocks by their place, all features.
_PLACED = (
    # In elements that are no text of the page: menus, but also long comments, adverts and forms among them, in articles and outside.
    (1, 1, 0, 0, 1, 1, 0, 0, 1, 0, 0, 0), (2, 1, 1, 1, 2, 1, 0, 0, 1, 0, 0, 0), (3, 0, 2, 1, 40, 0, 1, 0, 1, 0, 0, 0), (60, 0, 50, 0, 40, 0, 0, 0, 1, 0, 0, 0), (90, 0.05, 6, 0, 70, 0, 0, 0, 1, 0, 0, 0), (25, 0, 30, 0, 0, 0, 0, 0, 1, 0, 0, 0),
    (12, 0, 60, 0, 30, 0, 0, 1, 1, 0, 0, 0), (70, 0, 60, 0, 55, 0, 0, 1, 1, 0, 0, 0), (5, 0, 3, 0, 4, 0, 1, 1, 1, 0, 0, 0), (4, 0.5, 90, 0, 80, 0, 0, 1, 1, 0, 0, 0), (150, 0, 12, 0, 9, 0, 0, 0, 1, 0, 0, 0), (18, 0.2, 20, 0, 25, 0, 0, 1, 1, 0, 0, 0),
    (30, 0, 5, 1, 6, 1, 0, 0, 1, 0, 0, 0), (8, 0, 40, 0, 3, 1, 0, 0, 1, 0, 0, 0), (1, 0, 30, 0, 30, 0, 0, 0, 1, 0, 0, 0), (250, 0, 200, 0, 180, 0, 0, 0, 1, 0, 0, 0), (6, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0), (40, 0, 2, 0, 5, 0, 1, 0, 1, 0, 0, 0),
    (10, 0, 70, 0, 0, 0, 0, 0, 1, 0, 1, 0), (35, 0.1, 60, 0, 4, 1, 0, 1, 1, 0, 1, 0),
    # Outside of the article that holds the text.
    (40, 0, 30, 0, 50, 0, 0, 0, 0, 1, 0, 0), (6, 0, 50, 0, 40, 0, 1, 0, 0, 1, 0, 0), (3, 1, 2, 1, 60, 0, 0, 0, 0, 1, 0, 0), (90, 0.1, 5, 1, 4, 1, 0, 0, 0, 1, 0, 0), (12, 0, 0, 0, 80, 0, 0, 0, 0, 1, 0, 0), (2, 0, 60, 0, 0, 0, 0, 0, 0, 1, 0, 0),
    (25, 0, 90, 0, 10, 0, 0, 0, 0, 1, 0, 0), (180, 0, 60, 0, 70, 0, 0, 0, 0, 1, 0, 0), (9, 0, 7, 0, 8, 0, 1, 0, 0, 1, 0, 0), (1, 0, 1, 0, 1, 0, 0, 0, 0, 1, 0, 0), (5, 0, 200, 0, 30, 0, 0, 0, 0, 1, 1, 0), (60, 0.02, 45, 0, 0, 0, 0, 0, 0, 1, 0, 0),
    # What reads like a notice: short lines on pages without an article; not paragraphs, and not lines of an article.
    (6, 0, 40, 0, 0, 0, 0, 0, 0, 0, 1, 0), (9, 0, 60, 0, 5, 0, 0, 0, 0, 0, 1, 0), (7, 0.3, 30, 0, 8, 0, 0, 0, 0, 0, 1, 0), (14, 0, 80, 0, 0, 0, 0, 0, 0, 0, 1, 0), (20, 0.1, 0, 0, 60, 0, 0, 0, 0, 0, 1, 0), (4, 0, 12, 0, 0, 0, 0, 0, 0, 0, 1, 0),
    (12, 0, 20, 0, 6, 0, 0, 0, 0, 0, 1, 0), (18, 0.1, 5, 0, 45, 0, 0, 0, 0, 0, 1, 0), (60, 0, 50, 0, 40, 0, 0, 0, 0, 0, 1, 1), (45, 0, 30, 0, 70, 0, 0, 0, 0, 0, 1, 1), (120, 0, 90, 0, 20, 0, 0, 0, 0, 0, 1, 1), (80, 0.02, 6, 0, 60, 0, 0, 0, 0, 0, 1, 1),
    (8, 0, 50, 0, 40, 0, 0, 1, 0, 0, 1, 1), (15, 0, 60, 0, 70, 0, 0, 1, 0, 0, 1, 1), (5, 0, 3, 0, 90, 0, 1, 1, 0, 0, 1, 1), (40, 0, 60, 0, 50, 0, 0, 1, 0, 0, 1, 1),
    (3, 0, 43, 0, 8, 0, 0, 1, 0, 0, 1, 1), (3, 0, 9, 0, 13, 0, 0, 1, 0, 0, 1, 1), (4, 0, 82, 0, 12, 0, 0, 1, 0, 0, 1, 1), (2, 0, 5, 0, 14, 0, 0, 1, 0, 0, 1, 1), (5, 0, 70, 0, 0, 0, 0, 1, 0, 0, 1, 1),
)
LABELLED = (*((*row[:-1], 0, 0, 0, row[-1]) for row in _PLAIN), *_PLACED)


def _tag_end(page: str, at: int, limit: int) -> int:
    """The place after the > that ends the tag at `at`, or limit, the next <, if none does. A quoted value that doesn't end before limit, or not before a space, / or >, is none."""
    while m := _QUOTE.search(page, at, limit):
        if m[0] == ">":
            return m.end()
        shut = page.find(m[0], m.end(), limit)
        at = shut + 1 if shut >= 0 and page[shut + 1 : shut + 2] in (" ", "\t", "\n", "\r", "\f", "/", ">", "") else m.end()
    return limit


def _is_aside(name: str) -> bool:
    parts = [p for p in re.split("[-_0-9]+", name) if p]
    return any(p in ASIDE_PARTS for p in parts) and all(p in ASIDE_PARTS or p in OTHER_PARTS for p in parts)


class _Page:
    """One pass over a page: flat blocks, and the containers that they stand in."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, int, int, bool]] = []  # text, words, linked words, innermost container, heading
        self.containers: list[list] = [[-1, "", ""]]  # outer container, "main" or "aside" or neither, tag or "name"
        self.stack: list[tuple[str, bool, int]] = []  # tag, hidden, container outside of it
        self.depth = {"a": 0, "hidden": 0, "heading": 0}
        self.count: dict[str, int] = {}
        self.parts: list[tuple[str, bool]] = []
        self.at_container = 0
        self._read(page)
        self._close_block()

    def _close_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(p for p, _ in self.parts)).split())
            if text:
                n = len(text.split())
                linked = len(html.unescape(" ".join(p for p, a in self.parts if a)).split())
                self.blocks.append((text, n, min(n, linked), self.at_container, self.depth["heading"] > 0))
            self.parts.clear()

    def _pop(self) -> str:
        tag, hidden, self.at_container = self.stack.pop()
        self.count[tag] -= 1
        self.depth["hidden"] -= hidden
        self.depth["a"] -= tag == "a"
        self.depth["heading"] -= len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        return tag

    def _push(self, tag: str, attributes: str) -> None:
        names = [x.lower() for _, a, b, c in _ATTR.findall(attributes) for x in (a or b or c).split()] if attributes else []
        hidden = tag in HIDE or bool(attributes and _HIDDEN.search(attributes))
        self.stack.append((tag, hidden, self.at_container))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.depth["hidden"] += hidden
        self.depth["a"] += tag == "a"
        self.depth["heading"] += len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        named = tag not in ("html", "body") and any(map(_is_aside, names))
        kind = "aside" if tag in ASIDE_TAGS or named else "main" if tag in MAIN_TAGS or tag in ("div", "section") and any(x in MAIN_NAMES for x in names) else ""
        if kind:
            self.containers.append([self.at_container, kind, "named" if tag in MAIN_TAGS and kind == "aside" else tag if tag in MAIN_TAGS or tag in ASIDE_TAGS else "name"])
            self.at_container = len(self.containers) - 1

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            cut = page.find("<", at)
            cut = end if cut < 0 else cut
            if cut > at and not self.depth["hidden"]:
                self.parts.append((page[at:cut], self.depth["a"] > 0))
            if cut == end:
                return
            m = _NAME.match(page, cut + 1)
            if page.startswith("<!--", cut):
                shut = page.find("-->", cut + 4)
                at = end if shut < 0 else shut + 3
                continue
            if not m and page[cut + 1 : cut + 2] in ("!", "?", "/"):
                shut = page.find(">", cut)
                at = end if shut < 0 else shut + 1
                continue
            if not m:  # a < in the text
                if not self.depth["hidden"]:
                    self.parts.append(("&lt;", self.depth["a"] > 0))
                at = cut + 1
                continue
            limit = page.find("<", m.end())
            limit = end if limit < 0 else limit
            at = _tag_end(page, m.end(), limit)
            if at == end and page[-1] != ">":  # the page ends inside a tag
                return
            tag = m[1].lower()
            if tag in BLOCK:
                self._close_block()
            if page[cut + 1] == "/":
                if self.count.get(tag):
                    while self._pop() != tag:
                        pass
                continue
            attributes = page[m.end() : at].removesuffix(">")
            if tag in SKIP:
                shut = re.compile(f"</{tag}[^a-z0-9]", re.I).search(page, at)
                at = (page.find(">", shut.start()) + 1 or end) if shut else end
                self._close_block()
                continue
            if tag in ITEMS:  # an open one of the kind ends here
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == tag:
                        while len(self.stack) > k:
                            self._pop()
                        break
                    if self.stack[k][0] in HOLDERS:
                        break
            if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
                continue
            if tag == "body":
                while self.stack:
                    self._pop()
            self._push(tag, attributes)

    def placed(self) -> list[tuple[bool, bool, bool]]:
        """(in an article, aside, outside of the article that holds the text) of each block."""
        boxes = self.containers
        words, holds = [0] * len(boxes), [False] * len(boxes)
        for b in self.blocks:
            words[b[3]] += b[1]
        for i in range(len(boxes) - 1, 0, -1):
            words[boxes[i][0]] += words[i]
            holds[boxes[i][0]] |= holds[i] or boxes[i][1] == "main" and boxes[i][2] in MAIN_TAGS
        aside, inside = [False] * len(boxes), [False] * len(boxes)
        for i, (outer, kind, tag) in enumerate(boxes[1:], 1):
            # A name, or a form around the page, doesn't set aside what holds an article or most of the words.
            real = kind == "aside" and not (tag in ("name", "named", "form") and (holds[i] or words[i] > MOST * words[0])) and not (tag == "header" and inside[outer])
            if tag == "named" and not real:  # an article that only its name calls otherwise
                boxes[i][1:] = kind, tag = "main", "article"
            aside[i], inside[i] = aside[outer] or real, inside[outer] or kind == "main"
        own = [0] * len(boxes)
        for b in self.blocks:
            own[b[3]] += b[1] * (not aside[b[3]])
        for i in range(len(boxes) - 1, 0, -1):
            own[boxes[i][0]] += own[i]
        article = [False] * len(boxes)
        for i, (outer, kind, tag) in enumerate(boxes[1:], 1):
            article[i] = article[outer] or kind == "main" and not aside[i] and (tag in MAIN_TAGS or own[i] >= LEAST * own[0])
        mine = sum(b[1] for b in self.blocks if article[b[3]] and not aside[b[3]])
        has = mine > 0 and mine >= LEAST * own[0]
        return [(has and article[b[3]], aside[b[3]], has and not article[b[3]]) for b in self.blocks]


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, features) of the text blocks of a page, in order; blocks of white space only are none."""
    read = _Page(page)
    out = []
    for i, (b, place) in enumerate(zip(read.blocks, read.placed(), strict=True)):
        around = [(0, 0.0) if not 0 <= k < len(read.blocks) else (read.blocks[k][1], read.blocks[k][2] / read.blocks[k][1]) for k in (i - 1, i + 1)]
        out.append((b[0], [b[1], b[2] / b[1], *around[0], *around[1], float(b[4]), *map(float, place), float(bool(_NOTICE.search(b[0])))]))
    return out


def fit(table=LABELLED, depth: int = 12) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, left, right), or the share of main text in a leaf; ties go to the first feature."""
    data = np.array(table, dtype=float)

    def grow(rows: np.ndarray, left: int):
        y = rows[:, -1]
        if left == 0 or y.min() == y.max():
            return float(y.mean())
        best = None
        for f in range(rows.shape[1] - 1):
            values = np.unique(rows[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = rows[:, f] <= t
                cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(t), low)
        if best is None:
            return float(y.mean())
        return (best[1], best[2], grow(rows[best[3]], left - 1), grow(rows[~best[3]], left - 1))

    return grow(data, depth)


def is_main(tree, features: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


@lru_cache(1)
def default_tree():
    return fit()


def main_text(page: str | None, tree=None) -> str:
    tree = tree or default_tree()
    return "\n".join(text for text, f in blocks(page or "") if is_main(tree, f))


def extracted(df: DataFrame, key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per row of df: key, the columns in keep, text, n_chars.

    Null and empty pages and pages without main text give the empty text. A
    page that ends in the middle of a tag or a character reference is read up
    to there; a tag whose quote or > is missing is still a tag. The time is in
    proportion to the page. Repeated rows and keys give a row each; an empty
    table gives none.
    """
    small_batches(df.sparkSession)
    tree = fit()
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*names, "text", "n_chars"])

    rows = df.select(*names, F.col(page).alias("_page"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")
