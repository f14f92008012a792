"""Main text of web pages: flat blocks, judged by a decision tree on their own and their neighbours' shape."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import mapped

# Elements by what they do to text.
SKIPPED = frozenset("script style template noscript textarea select svg math iframe object canvas video audio title head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
CONTAINERS = frozenset("article main section div nav header footer aside form ul ol dl table figure details dialog fieldset menu body html".split())
BOILER_TAGS = frozenset("nav footer aside form dialog menu button fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
                         "breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
                         "subscription signup login share sharing social related recommended recommendations comment comments reply replies disqus widget "
                         "widgets pagination pager toolbar copyright disclaimer masthead topbar".split())
MAIN_WORDS = frozenset("article content main post story entry".split())

COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())
# First and last words of class names that tell of a state and not of what an element is.
STATE_FIRST = frozenset("no not has have with without is".split())
STATE_LAST = frozenset("open closed enabled disabled active on off visible".split())
NEVER_NAMED = frozenset("html body main".split())     # class words make no boilerplate of these
RAW = frozenset("script style textarea title iframe noscript".split())   # unclosed, they take the rest of the page
NO_BLOCKS_INSIDE = frozenset("p h1 h2 h3 h4 h5 h6 dt pre".split())

# How surely an element is boilerplate; an article or main element inside ends the first two.
NAMED, FORM, COMMENT, SURE = 1, 2, 3, 4

# A quote that is not closed ends with its tag.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:[\"'][^>]*)?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"\S+")


@lru_cache(4096)
def _kind(tag: str, attributes: str) -> tuple[int, bool]:
    """How surely an element is boilerplate, and whether it holds the main text, by tag, class, id and role."""
    level, main = FORM if tag == "form" else SURE if tag in BOILER_TAGS else 0, tag in ("article", "main")
    for name, *value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(value).lower()
        if name in ("class", "id") and tag not in NEVER_NAMED:
            for word in value.split():
                parts = re.split(r"[^a-z0-9]+", word)
                if parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
                    continue
                if not COMMENT_WORDS.isdisjoint(parts):
                    level = max(level, COMMENT)
                elif not BOILER_WORDS.isdisjoint(parts):
                    level = max(level, NAMED) if tag != "article" else level
                elif not MAIN_WORDS.isdisjoint(parts):
                    main = True
        elif name == "role":
            parts = set(value.split())
            level = max(level, SURE) if parts & BOILER_ROLES else level
            main |= bool(parts & {"main", "article"})
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            level = SURE
    return level, main and not level


@dataclass
class Block:
    text: str
    words: int
    linked: int
    level: int
    main: bool


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; white space inside a block is one space, empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []        # marked elements that are open: tag, how surely boilerplate, main
    parts: list[str] = []
    state = {"links": 0, "linked": 0}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            words = text.count(" ") + 1
            level, main = (stack[-1][1], stack[-1][2]) if stack else (0, False)
            out.append(Block(text, words, min(words, state["linked"]), level, main))
        state["linked"] = 0

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state["links"]:
                state["linked"] += len(text.split())

    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        closing = bool(found[1])
        if tag in SKIPPED:
            if not closing and not found[3].endswith("/"):
                if tag == "head":
                    end = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, at)
                else:
                    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                # Unclosed, others hide nothing but their own tag.
                at = end.end() if end else (size if tag in RAW else at)
            continue
        if tag in INLINE:
            if tag == "a":
                state["links"] = 0 if closing else 1
            elif tag in ("br", "wbr", "img"):
                parts.append(" " if tag == "br" else "")
            continue
        flush()
        state["links"] = 0
        while stack and (stack[-1][0] in NO_BLOCKS_INSIDE or (stack[-1][0] == tag and tag not in CONTAINERS and tag not in BOILER_TAGS)):
            stack.pop()                             # such an element ends where the next block begins
        if tag in CONTAINERS or tag in BOILER_TAGS:
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                level, main = _kind(tag, found[3])
                if tag == "header":                 # the header of an article belongs to it
                    level = level or (0 if any(x[2] for x in stack) else SURE)
                up = stack[-1] if stack else ("", 0, False)
                above = 0 if up[1] in (NAMED, FORM) and main and tag in ("article", "main") else up[1]
                stack.append((tag, max(level, above), (main or up[2]) and not max(level, above)))
        elif not closing and found[3]:
            level, _ = _kind(tag, found[3])
            if level:                               # a paragraph, heading or item that names itself boilerplate
                up = stack[-1] if stack else ("", 0, False)
                stack.append((tag, max(level, up[1]), False))
    flush()
    return out


FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "named", "main", "beside"]

# A small table of judged blocks, in the order of FEATURES; the last column is 1 for main text.
LABELLED = [
    # in an article or main element
    (120, 0.00, 60, 0.00, 80, 0.00, 0, 0, 1, 0, 1), (45, 0.05, 12, 0.00, 90, 0.00, 0, 0, 1, 0, 1), (1, 0.00, 40, 0.00, 33, 0.00, 0, 0, 1, 0, 1),
    (2, 0.00, 80, 0.00, 9, 0.00, 0, 0, 1, 0, 1), (9, 0.00, 1, 1.00, 70, 0.00, 0, 0, 1, 0, 1), (12, 0.00, 8, 0.00, 55, 0.00, 0, 0, 1, 0, 1),
    (60, 0.30, 40, 0.00, 40, 0.10, 0, 0, 1, 0, 1), (1, 0.00, 1, 0.00, 1, 0.00, 0, 0, 1, 0, 1), (4, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1, 0, 1),
    (6, 0.40, 30, 0.00, 25, 0.00, 0, 0, 1, 0, 1), (8, 1.00, 50, 0.10, 60, 0.00, 0, 0, 1, 0, 1), (3, 0.00, 1, 1.00, 8, 0.00, 0, 0, 1, 0, 1),
    (7, 0.00, 9, 0.00, 7, 0.00, 0, 0, 1, 0, 1), (2, 0.00, 3, 0.00, 5, 0.00, 0, 0, 1, 0, 1), (5, 0.00, 1, 0.00, 12, 0.00, 0, 0, 1, 0, 1),
    (1, 0.00, 7, 0.00, 6, 0.00, 0, 0, 1, 0, 1), (15, 0.00, 2, 0.00, 4, 0.00, 0, 0, 1, 0, 1), (80, 0.00, 1, 0.00, 2, 0.00, 0, 0, 1, 0, 1),
    (3, 0.00, 14, 0.00, 10, 0.00, 0, 0, 1, 0, 1), (11, 0.00, 6, 0.00, 0, 0.00, 0, 0, 1, 0, 1), (1, 0.00, 1, 1.00, 1, 0.00, 0, 0, 1, 0, 1),
    (30, 0.00, 9, 0.00, 1, 1.00, 0, 0, 1, 0, 1), (2, 0.00, 5, 1.00, 3, 1.00, 0, 0, 1, 0, 1), (200, 0.10, 3, 0.00, 7, 0.00, 0, 0, 1, 0, 1),
    (2, 1.00, 2, 1.00, 2, 1.00, 0, 0, 1, 0, 0), (5, 1.00, 6, 1.00, 4, 1.00, 0, 0, 1, 0, 0), (3, 1.00, 4, 1.00, 5, 1.00, 0, 0, 1, 0, 0),
    (20, 1.00, 40, 0.00, 50, 0.00, 0, 0, 1, 0, 1), (15, 1.00, 60, 0.00, 0, 0.00, 0, 0, 1, 0, 1), (30, 1.00, 50, 0.00, 45, 0.00, 0, 0, 1, 0, 1),
    # in an element that names itself boilerplate by its class only; long text among long text contradicts the name
    (7, 0.00, 1, 1.00, 10, 0.00, 0, 1, 0, 1, 0), (40, 0.00, 50, 0.00, 0, 0.00, 0, 1, 0, 1, 0), (90, 0.00, 80, 0.00, 70, 0.00, 0, 1, 0, 1, 0),
    (12, 0.10, 90, 0.00, 0, 0.00, 0, 1, 0, 0, 0), (25, 0.00, 60, 0.00, 90, 0.00, 0, 1, 0, 1, 0), (3, 0.00, 8, 0.00, 60, 0.00, 0, 1, 0, 0, 0),
    (30, 0.00, 9, 0.00, 12, 0.00, 0, 1, 0, 0, 0), (8, 0.00, 30, 0.00, 1, 0.00, 0, 1, 0, 0, 0), (45, 0.05, 6, 0.00, 20, 0.00, 0, 1, 0, 0, 0),
    (1, 1.00, 1, 1.00, 7, 0.00, 0, 1, 0, 0, 0), (20, 0.00, 4, 1.00, 30, 0.00, 0, 1, 0, 0, 0), (14, 0.00, 80, 0.00, 60, 0.00, 0, 1, 0, 1, 0),
    (60, 0.00, 60, 0.00, 60, 0.00, 0, 1, 0, 0, 1), (80, 0.00, 70, 0.00, 90, 0.00, 0, 1, 0, 0, 1), (150, 0.00, 0, 0.00, 120, 0.00, 0, 1, 0, 0, 1),
    (60, 0.00, 0, 0.00, 60, 0.00, 0, 1, 0, 0, 1), (60, 0.00, 60, 0.00, 0, 0.00, 0, 1, 0, 0, 1), (120, 0.05, 100, 0.00, 2, 0.00, 0, 1, 0, 0, 1),
    # in an element that names itself a menu, footer, advert, notice, form or comment
    (7, 0.00, 1, 1.00, 10, 0.00, 1, 0, 0, 1, 0), (40, 0.00, 50, 0.00, 0, 0.00, 1, 0, 0, 1, 0), (90, 0.00, 80, 0.00, 70, 0.00, 1, 0, 0, 1, 0),
    (12, 0.10, 90, 0.00, 0, 0.00, 1, 0, 0, 1, 0), (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0, 1, 0), (1, 1.00, 1, 1.00, 7, 0.00, 1, 0, 0, 1, 0),
    (25, 0.00, 60, 0.00, 90, 0.00, 1, 0, 0, 1, 0), (150, 0.02, 3, 0.00, 4, 0.00, 1, 0, 0, 1, 0), (3, 0.00, 8, 0.00, 60, 0.00, 1, 0, 0, 0, 0),
    (60, 0.00, 40, 0.00, 50, 0.00, 1, 0, 0, 0, 0), (30, 0.00, 9, 0.00, 12, 0.00, 1, 0, 0, 0, 0), (8, 0.00, 30, 0.00, 1, 0.00, 1, 0, 0, 0, 0),
    (2, 0.00, 20, 0.00, 35, 0.00, 1, 0, 0, 0, 0), (100, 0.00, 120, 0.00, 90, 0.00, 1, 0, 0, 0, 0), (45, 0.05, 6, 0.00, 20, 0.00, 1, 0, 0, 0, 0),
    # beside the article of a page that has one
    (6, 0.00, 1, 1.00, 10, 0.00, 0, 0, 0, 1, 0), (40, 0.00, 70, 0.00, 30, 0.00, 0, 0, 0, 1, 0), (12, 0.00, 50, 0.00, 0, 0.00, 0, 0, 0, 1, 0),
    (3, 0.00, 60, 0.00, 45, 0.00, 0, 0, 0, 1, 0), (90, 0.00, 20, 0.00, 15, 0.00, 0, 0, 0, 1, 0), (25, 0.30, 5, 0.00, 80, 0.00, 0, 0, 0, 1, 0),
    # on pages that mark neither
    (80, 0.00, 50, 0.00, 70, 0.00, 0, 0, 0, 0, 1), (35, 0.10, 10, 0.00, 90, 0.05, 0, 0, 0, 0, 1), (25, 0.00, 40, 0.00, 30, 0.00, 0, 0, 0, 0, 1),
    (140, 0.20, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1), (20, 0.00, 5, 0.00, 60, 0.00, 0, 0, 0, 0, 1), (6, 0.00, 50, 0.00, 60, 0.00, 0, 0, 0, 0, 1),
    (8, 0.00, 2, 1.00, 70, 0.00, 0, 0, 0, 0, 1), (3, 0.00, 45, 0.00, 40, 0.00, 0, 0, 0, 0, 1), (4, 0.00, 12, 0.00, 30, 0.00, 0, 0, 0, 0, 1),
    (9, 0.00, 40, 0.00, 20, 0.00, 0, 0, 0, 0, 1), (1, 0.00, 25, 0.00, 18, 0.00, 0, 0, 0, 0, 1), (16, 0.00, 30, 0.00, 4, 0.00, 0, 0, 0, 0, 1),
    (30, 0.00, 40, 0.00, 0, 0.00, 0, 0, 0, 0, 1), (28, 0.05, 2, 1.00, 3, 0.00, 0, 0, 0, 0, 1), (50, 0.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0, 1),
    (22, 0.10, 5, 0.00, 5, 0.00, 0, 0, 0, 0, 1), (70, 0.20, 0, 0.00, 4, 1.00, 0, 0, 0, 0, 1), (35, 0.00, 12, 0.00, 9, 0.00, 0, 0, 0, 0, 1),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0, 0), (4, 1.00, 0, 0.00, 3, 1.00, 0, 0, 0, 0, 0), (3, 0.70, 2, 1.00, 5, 0.60, 0, 0, 0, 0, 0),
    (6, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 0), (7, 0.00, 4, 0.50, 6, 0.00, 0, 0, 0, 0, 0), (2, 0.00, 3, 1.00, 0, 0.00, 0, 0, 0, 0, 0),
    (30, 0.80, 12, 0.70, 9, 1.00, 0, 0, 0, 0, 0), (60, 0.90, 50, 0.00, 40, 0.00, 0, 0, 0, 0, 0), (9, 0.60, 40, 0.00, 3, 1.00, 0, 0, 0, 0, 0),
    (4, 0.00, 1, 1.00, 5, 0.00, 0, 0, 0, 0, 0),
]


class Tree:
    """A binary decision tree that splits on the largest fall of Gini impurity."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 6):
        p = labels.mean()
        self.split, self.value = None, bool(p >= 0.5)
        if depth == 0 or p in (0.0, 1.0):
            return
        best = (1e-12, None)
        for f in range(rows.shape[1]):
            levels = np.unique(rows[:, f])
            for cut in (levels[1:] + levels[:-1]) / 2:
                low = rows[:, f] <= cut
                left = sum(len(y) * 2 * y.mean() * (1 - y.mean()) for y in (labels[low], labels[~low]))
                gain = len(labels) * 2 * p * (1 - p) - left
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut))
        if best[1]:
            f, cut = self.split = best[1]
            low = rows[:, f] <= cut
            self.low, self.high = Tree(rows[low], labels[low], depth - 1), Tree(rows[~low], labels[~low], depth - 1)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(rows), self.value)
        low = rows[:, self.split[0]] <= self.split[1]
        out = np.empty(len(rows), bool)
        out[low], out[~low] = self.low(rows[low]), self.high(rows[~low])
        return out


def train(labelled=LABELLED) -> Tree:
    table = np.array(labelled, float)
    return Tree(table[:, :-1], table[:, -1])


def features(found: list[Block]) -> np.ndarray:
    """The shape of each block. A block is beside the main text only if marked text is most of a page's unlinked text."""
    own = np.array([(b.words, b.linked / b.words, b.level >= FORM, b.level == NAMED, b.main) for b in found], float).reshape(-1, 5)
    plain = own[:, 0] * (1 - own[:, 1]) * (own[:, 2] == 0)
    most = 2 * plain[own[:, 4] > 0].sum() > plain.sum()
    gap, beside = np.zeros((1, 2)), (own[:, 4:] == 0) & (most or bool((own[:, 4] > 0).all()))
    before, after = np.concatenate([gap, own[:-1, :2]])[:len(own)], np.concatenate([own[1:, :2], gap])[-len(own):]
    return np.concatenate([own[:, :2], before, after, own[:, 2:], beside], axis=1)


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The blocks that the tree takes for main text, one line each; null and empty pages give an empty text."""
    found = [blocks(p or "") for p in pages]
    shapes = [features(f) for f in found if f]
    good = tree(np.concatenate(shapes)).tolist() if shapes else []
    out, at = [], 0
    for f in found:
        out.append("\n".join(b.text for b, ok in zip(f, good[at:at + len(f)]) if ok))
        at += len(f)
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", tree: Tree | None = None) -> DataFrame:
    """(key, url, text, n_chars) of every page; pages are read whole and never shuffled.

    Null and empty pages, and pages without main text, have an empty text. Null and repeated keys and urls
    stay as they are; an empty table gives no rows; other columns are not read, whatever their names.
    Pages of any length are read in one pass.
    """
    tree = tree or train()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def read(batch):
        texts = main_texts(batch.column(2).to_pylist(), tree)
        return {key: batch.column(0), url: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return mapped(pages.select(key, url, page), read, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint", page)
