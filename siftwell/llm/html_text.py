"""Main text of web pages from flat text blocks and a decision tree.

One scan cuts the markup to a flat list of blocks, each with its words, the share of them in links, and the
words and link shares of its neighbours.  What the markup says of a block (an element or a class that as a rule
holds no main text; an article around it, or elsewhere on the page) is further evidence, which the words and links
may overrule: a list of links is none of the article's text although the article holds it, and long texts without
links are main text although a class calls them something else.  A decision tree, grown here from the labelled
table below, keeps or drops each block.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm.shared import pick, slices

# Elements by their part in a page.
HIDDEN = {"script", "style", "noscript", "template", "textarea", "select", "svg", "math", "iframe", "object", "title", "head", "canvas", "audio", "video", "datalist"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "select", "object", "canvas", "audio", "video", "datalist"}
ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "ruby", "rb", "rt", "rp", "picture", "source", "map", "area", "nobr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY_LIKE = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}
HINTS = {"ad", "ads", "adv", "advert", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo", "search", "alert", "replies"}
BODY_HINTS = {"article", "post", "entry", "story", "main"}

NEGATIONS = {"has", "no", "not", "with", "without", "hide"}

_DECLARATION = r"""<!--(?:.*?-->|.*)|{}<[!?][^>]*+>|"""
_ELEMENT = r"""<(/?)([A-Za-z][^\s/>]*+)((?>"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>"""
_TAG = re.compile(_DECLARATION.format(r"<!\[CDATA\[.*?\]\]>|") + _ELEMENT, re.S)
_PLAIN_TAG = re.compile(_DECLARATION.format("") + _ELEMENT, re.S)  # where no section ends any more
_COMMENT = re.compile("<!--.*", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

FEATURES = ("words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after", "aside", "article", "heading")
# aside: 1 by its element, 0.5 by a class, id or role, which may mislead
# article: 1 within one, -1 beside one on a page that has one, 0 on a page without
# Labelled blocks, in the order of FEATURES and then 1 for main text.
LABELLED = (
    # inside an article: paragraphs long and short, headings, items of lists with a link here and there
    (120, 0.0, 9, 0.0, 80, 0.0, 0, 1, 0, 1), (60, 0.1, 120, 0.0, 44, 0.0, 0, 1, 0, 1), (1, 0.0, 60, 0.0, 30, 0.0, 0, 1, 0, 1),
    (2, 0.0, 1, 1.0, 15, 0.0, 0, 1, 0, 1), (9, 0.0, 12, 0.0, 90, 0.0, 0, 1, 1, 1), (12, 0.0, 1, 1.0, 3, 0.0, 0, 1, 1, 1),
    (5, 1.0, 40, 0.0, 35, 0.0, 0, 1, 0, 1), (7, 0.4, 30, 0.1, 4, 0.5, 0, 1, 0, 1), (300, 0.0, 10, 0.0, 8, 0.3, 0, 1, 0, 1),
    (25, 0.0, 2, 0.0, 7, 0.2, 0, 1, 0, 1), (3, 0.0, 25, 0.0, 9, 0.0, 0, 1, 1, 1), (40, 0.0, 14, 0.0, 8, 0.0, 0, 1, 0, 1),
    (4, 0.0, 3, 1.0, 2, 1.0, 0, 1, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (12, 0.0, 8, 1.0, 1, 1.0, 0, 1, 1, 1),
    (2, 0.0, 5, 1.0, 0, 0.0, 0, 1, 0, 1), (8, 0.3, 6, 0.9, 6, 0.9, 0, 1, 0, 1), (30, 0.5, 3, 1.0, 4, 1.0, 0, 1, 0, 1),
    (5, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1, 1), (7, 0.0, 2, 0.0, 9, 1.0, 0, 1, 0, 1), (50, 0.2, 6, 0.7, 7, 1.0, 0, 1, 0, 1),
    (1, 1.0, 12, 0.0, 5, 0.0, 0, 1, 0, 1), (6, 0.9, 20, 0.1, 3, 0.2, 0, 1, 0, 1), (1, 0.0, 1, 1.0, 6, 0.2, 0, 1, 0, 1),
    (40, 0.0, 30, 0.0, 0, 0.0, 0, 1, 0, 1), (12, 0.0, 60, 0.0, 1, 0.0, 0, 1, 0, 1), (9, 0.2, 25, 0.0, 0, 0.0, 0, 1, 0, 1),
    (5, 0.0, 8, 0.0, 1, 0.0, 0, 1, 0, 1), (80, 0.0, 50, 0.0, 1, 0.5, 0, 1, 0, 1), (6, 0.0, 2, 0.0, 0, 0.0, 0, 1, 1, 1),
    # inside an article: lists of links to elsewhere, one beside the other
    (6, 1.0, 5, 1.0, 7, 1.0, 0, 1, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0),
    (9, 0.95, 8, 1.0, 9, 1.0, 0, 1, 0, 0), (4, 1.0, 6, 1.0, 11, 0.9, 0, 1, 0, 0), (14, 1.0, 9, 0.95, 12, 1.0, 0, 1, 0, 0),
    # inside an article, but of an element or class for other things
    (90, 0.0, 80, 0.0, 50, 0.0, 1, 1, 0, 0), (12, 0.3, 70, 0.0, 20, 0.0, 1, 1, 0, 0), (3, 0.0, 90, 0.0, 12, 0.5, 1, 1, 1, 0),
    (30, 0.1, 12, 0.0, 5, 0.6, 0.5, 1, 0, 0), (4, 0.0, 60, 0.0, 50, 0.0, 0.5, 1, 0, 0), (18, 0.0, 40, 0.0, 30, 0.0, 0.5, 1, 0, 0),
    (60, 0.0, 20, 0.0, 15, 0.0, 0.5, 1, 0, 0), (120, 0.0, 80, 0.0, 90, 0.0, 0.5, 1, 0, 0), (75, 0.05, 60, 0.0, 4, 0.3, 0.5, 1, 0, 0),
    (200, 0.0, 100, 0.0, 100, 0.0, 0.5, 1, 0, 0), (55, 0.0, 50, 0.0, 60, 0.0, 0.5, 1, 0, 0), (47, 0.0, 80, 0.0, 75, 0.0, 0.5, 1, 0, 0),
    # beside an article: menus, adverts, footers, notices, comments, forms
    (1, 1.0, 0, 0.0, 1, 1.0, 1, -1, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 1, -1, 0, 0), (14, 0.0, 1, 1.0, 9, 0.0, 0.5, -1, 0, 0),
    (35, 0.0, 2, 1.0, 11, 0.0, 0.5, -1, 0, 0), (8, 0.2, 120, 0.0, 0, 0.0, 1, -1, 0, 0), (20, 0.0, 60, 0.0, 0, 0.0, 1, -1, 0, 0),
    (150, 0.0, 3, 0.0, 90, 0.0, 1, -1, 0, 0), (6, 0.0, 150, 0.0, 4, 1.0, 1, -1, 1, 0), (60, 0.0, 45, 0.0, 50, 0.0, 0.5, -1, 0, 0),
    (11, 0.0, 2, 1.0, 10, 0.0, 0, -1, 0, 0), (4, 0.0, 0, 0.0, 1, 1.0, 0, -1, 1, 0), (16, 0.1, 9, 0.0, 0, 0.0, 0, -1, 0, 0),
    (45, 0.0, 8, 0.0, 6, 0.0, 0, -1, 0, 0), (5, 1.0, 5, 1.0, 70, 0.0, 0, -1, 0, 0), (70, 0.2, 5, 1.0, 12, 0.0, 0, -1, 0, 0),
    (60, 0.0, 15, 0.0, 8, 0.0, 0, -1, 0, 0), (25, 0.0, 40, 0.0, 30, 0.1, 0, -1, 0, 0), (9, 0.0, 20, 0.0, 14, 0.0, 0, -1, 0, 0),
    (48, 0.0, 70, 0.0, 8, 1.0, 0.5, -1, 0, 0), (110, 0.0, 100, 0.0, 120, 0.0, 0.5, -1, 0, 0), (70, 0.0, 60, 0.0, 55, 0.0, 0.5, -1, 0, 0),
    # pages that mark no article: long blocks with few links, headings before them, short blocks among them
    (110, 0.0, 8, 0.0, 70, 0.0, 0, 0, 0, 1), (40, 0.05, 70, 0.0, 35, 0.0, 0, 0, 0, 1), (22, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 1),
    (8, 0.0, 3, 1.0, 110, 0.0, 0, 0, 1, 1), (6, 0.0, 90, 0.0, 45, 0.0, 0, 0, 1, 1), (5, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 1),
    (16, 0.1, 45, 0.0, 80, 0.0, 0, 0, 0, 1), (35, 0.0, 2, 1.0, 5, 0.8, 0, 0, 0, 1), (9, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 1),
    (20, 0.0, 35, 0.0, 3, 1.0, 0, 0, 0, 1), (12, 0.0, 4, 0.0, 40, 0.0, 0, 0, 0, 1), (28, 0.1, 7, 0.0, 9, 0.0, 0, 0, 0, 1),
    # the same under a class that misleads
    (70, 0.0, 55, 0.0, 60, 0.0, 0.5, 0, 0, 1), (45, 0.05, 60, 0.0, 38, 0.0, 0.5, 0, 0, 1), (120, 0.0, 9, 0.0, 80, 0.0, 0.5, 0, 0, 1),
    (50, 0.0, 90, 0.0, 4, 1.0, 0.5, 0, 0, 1),
    (65, 0.0, 4, 0.5, 45, 0.0, 0.5, 0, 0, 1), (42, 0.0, 80, 0.0, 1, 1.0, 0.5, 0, 0, 1), (95, 0.0, 1, 1.0, 60, 0.0, 0.5, 0, 0, 1),
    # such pages' menus, link lists, adverts, footers
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0), (2, 0.0, 3, 1.0, 3, 1.0, 0, 0, 1, 0), (12, 0.9, 60, 0.0, 10, 1.0, 0, 0, 0, 0),
    (6, 0.5, 8, 0.7, 2, 1.0, 0, 0, 0, 0), (7, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 0), (8, 0.1, 5, 0.9, 0, 0.0, 0, 0, 0, 0),
    (30, 0.7, 20, 0.8, 15, 0.9, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (5, 0.0, 25, 0.0, 0, 0.0, 0, 0, 0, 0),
    (2, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 2, 0.0, 0, 0, 0, 0),
    (4, 1.0, 40, 0.0, 1, 1.0, 0, 0, 0, 0), (1, 1.0, 2, 1.0, 9, 0.0, 0, 0, 0, 0), (3, 1.0, 1, 1.0, 0, 0.0, 0, 0, 0, 0),
    (28, 0.0, 3, 1.0, 40, 0.0, 0.5, 0, 0, 0), (14, 0.0, 30, 0.0, 12, 0.0, 0.5, 0, 0, 0), (9, 0.0, 2, 1.0, 60, 0.0, 0.5, 0, 0, 0),
    (80, 0.1, 30, 0.0, 12, 0.0, 1, 0, 0, 0), (2, 1.0, 40, 0.0, 2, 1.0, 1, 0, 0, 0), (5, 0.0, 25, 0.0, 60, 0.0, 1, 0, 1, 0),
    (60, 0.0, 70, 0.0, 50, 0.0, 1, 0, 0, 0), (20, 0.6, 10, 0.9, 12, 0.8, 0.5, 0, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A binary tree by Gini impurity: (feature, threshold, at most, above), leaves are the share of ones."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best, n = None, len(y)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = y[x[:, f] <= cut]
            k, ones, total = len(left), left.sum(), y.sum()
            impure = ones * (k - ones) / k + (total - ones) * (n - k - total + ones) / (n - k)
            if best is None or impure < best[0] - 1e-12:
                best = impure, f, float(cut)
    if best is None:
        return share
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def default_tree():
    rows = np.array(LABELLED, float)
    return grow(rows[:, :-1], rows[:, -1])


def decide(tree, features) -> bool:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if features[f] <= cut else high
    return tree >= 0.5


def _hints(attributes: str) -> set[str]:
    """Words of classes, ids and roles, but for names such as no-sidebar or with-menu."""
    out: set[str] = set()
    for x in _NAMES.finditer(attributes):
        for name in (x[1] or x[2] or x[3] or "").lower().split():
            parts = re.split(r"[_-]+", name)
            if not NEGATIONS & set(parts):
                out.update(parts)
    return out


def blocks(html: str) -> list[tuple[str, int, float, float, bool, bool]]:
    """(text, words, link share, aside, article, heading) of each block that has text, in page order.

    Linear in the page: where no tag, section or element of a name can end any more, none is looked for.
    """
    out: list = []
    stack: list[tuple[str, float, bool]] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    aside, article, heading = 0.0, False, False
    links, linked, at, n = 0, 0, 0, len(html)
    last, section = html.rfind(">"), html.rfind("]]>")

    def flush():
        nonlocal linked
        words = "".join(parts).split()
        if words:
            out.append((" ".join(words), len(words), min(1.0, linked / len(words)), aside, article, heading))
        parts.clear()
        linked = 0

    def say(text: str):
        nonlocal linked
        if text:
            text = unescape(text)
            parts.append(text)
            if links:
                linked += len(text.split())

    def leave(i: int):
        nonlocal aside, article
        _, aside, article = stack[i]
        open_.subtract(x[0] for x in stack[i:])
        del stack[i:]

    while at < n:
        m = (_COMMENT if at > last else _TAG if at <= section else _PLAIN_TAG).search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5]) if m.re.groups else None
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1] or m[4])
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in INLINE:
            continue
        flush()
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}[^>]*+>", re.I).search(html, at) if at <= last else None
            at = end.end() if end else n
            continue
        if name in VOID:
            continue
        if closing:
            if open_[name] > 0:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                links = 0
        else:
            if stack and (stack[-1][0] == "p" or name in CLOSED_BY_LIKE and stack[-1][0] == name):  # a block ends an open paragraph
                leave(len(stack) - 1)
            stack.append((name, aside, article))
            open_[name] += 1
            hints = _hints(m[3] or m[6] or "")
            body = bool(hints & BODY_HINTS)
            within = name in ("article", "main") or (body and name in ("div", "section"))
            if within and aside < 1:
                aside = 0.0  # a class around an article says nothing of it
            if name in ASIDE or name in HIDDEN or (name in ("header", "footer") and not article):
                aside = 1.0
            elif hints & HINTS and not (body and name in ("article", "main", "section", "div", "body")):
                aside = max(aside, 0.5)
            article = article or within
        heading = any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-2:])
    flush()
    return out


def described(found) -> list[tuple]:
    """FEATURES of each block."""
    has = any(article and not aside for *_, aside, article, _ in found)
    out = []
    for i, (_, words, links, aside, article, heading) in enumerate(found):
        _, wb, lb, *_ = found[i - 1] if i else ("", 0, 0.0)
        _, wa, la, *_ = found[i + 1] if i + 1 < len(found) else ("", 0, 0.0)
        out.append((words, links, wb, lb, wa, la, aside, 1 if article else -1 if has else 0, heading))
    return out


def main_text(html: str, tree=None) -> str:
    tree = tree or default_tree()
    found = blocks(html)
    return "\n".join(b[0] for b, features in zip(found, described(found), strict=True) if decide(tree, features))


def _run(tree):
    def run(batches):
        for part in slices(batches, "html"):
            text = [main_text(h or "", tree) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page from its whole html.

    Returns per input row: page_id long, url string, text string (blocks joined by a line feed, empty if
    none), n_chars long.  Null or empty html: empty text.  Null and repeated ids and urls stay as they are.
    Broken markup (unclosed elements, comments, quotes) is read as far as it goes.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    pages = pick(pages, page_id=f"{id_col}:long", url=f"{url_col}:string", html=f"{html_col}:string")
    return pages.mapInArrow(_run(default_tree()), "page_id long, url string, text string, n_chars long")
