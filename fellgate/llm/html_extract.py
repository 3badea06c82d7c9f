"""Main text of web pages by tag-path ratios.

Method: one pass cuts a page into blocks (runs of text between block-level
tags), each with its root-to-leaf tag path.  Text length, punctuation and link
text are summed over each path of the page and divided by its blocks; the ratios
are smoothed over neighbouring blocks in page order, fused into one score, and
paths whose score passes a threshold are content.  The nearest element that
holds all content (an article or main element where one does) is then taken
whole, less the parts whose tag, role or class says that they are no article.

Defined results: null, empty or tagless html gives its own text or an empty one;
unclosed tags and comments end with the page; repeated rows are extracted alike;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by how they lay out, and what is never an article's text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg math object select button canvas audio video datalist".split())
DROPPED = frozenset("head nav footer aside form dialog menu frameset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
# Marks are whole names, or names whose parts are all marks or say what a mark is made of (cookie-notice, share-buttons); has-sidebar or no-comments say nothing about the element itself.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adslot adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
PARTS = frozenset("area bar block box button buttons form item items link links list posts section slot".split())
WHOLE = frozenset("html body main".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
STOPS = frozenset("ul ol dl table".split())
PUNCTUATION = re.compile(r"[.,;:!?。，！？、…]")

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+>|[^>]*(?:>|\Z)))""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SMOOTH = np.array([1, 2, 3, 2, 1], float) / 9


def _marked(value: str, inside: bool) -> bool:
    """Does one of these class names or ids mark something else than the article?"""
    for name in value.strip("\"'").lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if parts and (parts[0] in MARKS and all(x in MARKS or x in PARTS for x in parts) or (not inside and parts in (["header"], ["site", "header"], ["page", "header"]))):
            return True
    return False


def _no_article(tag: str, attrs: str, inside: bool) -> int:
    """Is this element something else than the article? 1: by its tag, 2: by its role, class or as a form, which may prove wrong; inside: it stands in an article or main element."""
    if tag == "form":
        return 2
    if tag in DROPPED or (tag == "header" and not inside):
        return 1
    for name, value in _ATTR.findall(attrs):
        if ROLES.intersection(re.split(r"[^a-z]+", value.lower())) if name.lower() == "role" else _marked(value, inside):
            return 2
    return 0


class _Node:
    """An element: its place in the page's order, the end of its subtree, its path, and what marks it as no article."""

    __slots__ = ("tag", "path", "parent", "mark", "marked", "hard", "inside", "article", "depth", "scope", "index")

    def __init__(self, tag: str, path: int, parent: _Node | None, mark: int, index: int) -> None:
        self.tag, self.path, self.parent, self.mark, self.index = tag, path, parent, mark, index
        self.marked = self if mark else parent.marked if parent else None  # the nearest marked element, itself included
        self.hard = mark == 1 or bool(parent and parent.hard)  # it or one around it is marked by its tag
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.article = tag == "article" or bool(parent and parent.article)
        self.depth = parent.depth + 1 if parent else 0
        self.scope = self.depth if tag in STOPS else parent.scope if parent else -1  # depth of the nearest list or table


Block = tuple[_Node, str, int]


def _may_drop(tag: str, parent: _Node) -> bool:
    """html, body and main are never dropped, an article only within another one (as comments are)."""
    return tag not in WHOLE and (tag != "article" or parent.article)


def blocks(page: str) -> tuple[list[Block], list[_Node]]:
    """(element, text, characters within links) of each block in page order, and all elements in page order.

    Time and memory follow the page, however deep it is nested: a path is a number for its parent's path and its own
    label, and elements that are open are found by a stack for each tag."""
    paths: dict[tuple[int, str], int] = {}
    root = here = _Node("", 0, None, 0, 0)
    nodes, opened = [root], {"": [root]}
    out: list[Block] = []
    text: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((here, joined, linked))
            text.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if "&" in part:
            part = html.unescape(part)
        text.append(part)
        if in_link:
            linked += len(part)

    def close(last: _Node) -> None:
        """Close elements up to this one; each is closed once, so this adds up to the number of elements."""
        nonlocal here
        while True:
            node = here
            opened[node.tag].pop()
            here = node.parent
            if node is last:
                return

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = not m[1]
        elif tag in BLOCK:
            flush()
            in_link = False
            if m[1]:
                if opened.get(tag):
                    close(opened[tag][-1])
                continue
            if tag in VOID:
                continue
            if here.tag == "p":  # a paragraph ends where a block begins, so none lies deeper
                close(here)
            if tag in CLOSES:  # of those that it ends, the outermost in its list or table
                ends = [n for name in CLOSES[tag] for n in _in_scope(opened.get(name, []), here.scope)]
                if ends:
                    close(min(ends, key=lambda n: n.depth))
            words = _ATTR.search(m[3]) if m[3] != ">" else None
            label = tag + ("." + words[2].strip("\"'").split(" ")[0] if words else "")
            mark = _no_article(tag, m[3], here.inside) if m[3] != ">" or tag in DROPPED or tag == "header" else 0
            path = paths.setdefault((here.path, label), len(paths) + 1)
            here = _Node(tag, path, here, mark if mark and _may_drop(tag, here) else 0, len(nodes))
            nodes.append(here)
            opened.setdefault(tag, []).append(here)
    if at < len(page):
        add(page[at:])
    flush()
    return out, nodes


def _in_scope(stack: list[_Node], scope: int) -> Iterator[_Node]:
    for node in reversed(stack):
        if node.depth <= scope:
            return
        yield node


def _content(kept: list[Block]) -> np.ndarray:
    """Which blocks stand on content paths."""
    _, path = np.unique([n.path for n, _, _ in kept], return_inverse=True)
    length = np.array([len(t) for _, t, _ in kept], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t, _ in kept], float)
    links = np.array([k for _, _, k in kept], float)
    count = np.bincount(path)
    text_ratio, mark_ratio = (np.bincount(path, x)[path] / count[path] for x in (length, marks))
    link_share = (np.bincount(path, links) / np.maximum(np.bincount(path, length), 1))[path]
    smooth = [np.convolve(np.pad(x, 2, mode="edge"), _SMOOTH, "valid") for x in (text_ratio, mark_ratio)]
    fused = smooth[0] * (1 + smooth[1]) * np.maximum(0, 1 - link_share)
    score = np.bincount(path, fused) / count
    return (score >= min(score.mean(), 0.5 * score.max()))[path]


def _restore(found: list[Block], nodes: list[_Node]) -> list[Block]:
    """The blocks that are not dropped. Elements marked by role or class, or as a form, stay if they hold most of the
    text on content paths; unless it is a form, no article, main or h1 may stand outside (comments can be longer than what they are about)."""
    rows = [b for b in found if not b[0].hard]
    if not any(b[0].marked for b in rows):
        return rows
    # sums over everything in each marked element, from the innermost outwards
    held, titles = dict.fromkeys((n.index for n in nodes if n.mark), 0), {}
    total = every = 0
    for (node, text, _), good in zip(rows, _content(rows)):
        size, title = len(text) if good else 0, int(node.inside or node.tag == "h1")
        total, every = total + size, every + title
        if node.marked:
            held[node.marked.index] += size
            titles[node.marked.index] = titles.get(node.marked.index, 0) + title
    marked = [n for n in nodes if n.mark]
    for n in reversed(marked):
        over = n.parent.marked
        if over:
            held[over.index] += held[n.index]
            titles[over.index] = titles.get(over.index, 0) + titles.get(n.index, 0)
    stays: dict[int, bool] = {}
    for n in marked:
        wrong = held[n.index] > 0 and 2 * held[n.index] > total and (n.tag == "form" or titles.get(n.index, 0) == every)
        stays[n.index] = wrong and (not n.parent.marked or stays[n.parent.marked.index])
    return [b for b in rows if not b[0].marked or stays[b[0].marked.index]]


def _content_root(kept: list[Block], nodes: list[_Node]) -> _Node:
    """The nearest element around all blocks on content paths: an article or main element where one is around them."""
    holds, titled = [0] * len(nodes), [False] * len(nodes)
    total = 0
    for (node, _, _), good in zip(kept, _content(kept)):
        holds[node.index] += int(good)
        titled[node.index] |= node.tag == "h1"  # a headline may stand above the article, in main
        total += int(good)
    for node in reversed(nodes[1:]):
        holds[node.parent.index] += holds[node.index]
        titled[node.parent.index] |= titled[node.index]
    around = [n for n in nodes if holds[n.index] == total]
    holders = [n for n in around if n.tag in ("article", "main")]
    if holders:
        return max(holders, key=lambda n: (titled[n.index], n.depth))
    common = max(around, key=lambda n: n.depth)
    while common.parent and common.tag not in ("body", "html", "div", "section", "td"):
        common = common.parent  # never a single paragraph: its neighbours belong to the same text
    return common


def main_text(page: str | None) -> str:
    """The article of a page, one line for each block."""
    found, nodes = blocks(page or "")
    kept = _restore(found, nodes)
    if not kept:
        return ""
    root = _content_root(kept, nodes)
    end = next((n.index for n in nodes[root.index + 1 :] if n.depth <= root.depth), len(nodes))
    return "\n".join(text for node, text, _ in kept if root.index <= node.index < end)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
