"""Main text of web pages: flat text blocks, judged by their words and links and those of their neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, sliced

# Names of HTML elements.
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead title tr ul".split()
)
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "button", "select", "title"}
# Silent elements whose content is text alone, those that end where a block of the page starts, and what a head may hold.
RAW = {"script", "style", "textarea", "title"}
INLINE = {"button", "select"}
OF_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
OF_PAGE = {"article", "blockquote", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "ol", "p", "section", "table", "ul"}
MARGINS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
CONTENT = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Names that margins go by in classes, ids and roles, and words that such names are made up with.
MARGIN_NAMES = re.compile(
    r"ads?|advert\w*|banners?|sponsor\w*|promos?|promotions?|cookies?|consent|notices?|popup|modal|overlay|newsletter|subscribe|nav|navbar|navigation|menus?|breadcrumbs?"
    r"|sidebars?|widgets?|related|share|sharing|social|comments?|commentlist|replies|reply|disqus|footer|header|masthead|copyright|pagination|pager|login|signin|search|complementary|contentinfo"
)
NEUTRAL = re.compile(
    r"\d+|aside|area|bar|block|body|bottom|box|btn|button|col|container|content|entry|footer|form|global|group|header|inner|item|items|left|links?|list|main|mobile|module|outer|page"
    r"|panel|primary|right|row|secondary|section|site|slot|sticky|text|title|top|unit|wrap|wrapper|zone"
)
COMMENTS = {"comment", "comments", "commentlist", "reply", "replies"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WHITE = re.compile(r"[ \t\n\r\f\v ]+")
NUMBERS = ["words", "links", "before_words", "before_links", "after_words", "after_links", "margin", "inside", "heading", "ends"]


@dataclass
class Block:
    """A run of text between block elements."""

    text: str
    words: int
    linked: int
    margin: float
    inside: bool
    heading: bool


def named_margin(names: str) -> float:
    """Whether class names, ids or roles say margin: 1 if a whole name does, beside neutral words; 1/2 if only a part of one."""
    found = 0.0
    for name in names.lower().split():
        parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
        hits = [bool(MARGIN_NAMES.fullmatch(p)) for p in parts]
        if any(hits):
            whole = all(h or NEUTRAL.fullmatch(p) for h, p in zip(hits, parts, strict=True))
            found = max(found, 1.0 if whole else 0.5)
    return found


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, without scripts, styles, comments and hidden parts.

    What authors leave open ends where browsers end it: a head at the first element that it cannot hold, a silent
    element with the element around it, a button or select also where a block of the page starts.
    """
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, float, bool, bool]] = []  # element; margin, content or hidden from there on
    skipped: list[str] = []  # silent elements and what is open in them
    at = links = 0
    in_head = False

    def close() -> None:
        text = WHITE.sub(" ", html.unescape("".join(t for t, _ in parts))).strip()
        if text:
            words = len(text.split())
            linked = sum(len(html.unescape(t).split()) for t, in_link in parts if in_link)
            _, margin, inside, hidden = stack[-1] if stack else ("", 0.0, False, False)
            if not hidden:
                found.append(Block(text, words, min(words, linked), margin, inside, any(s[0] in HEADINGS for s in stack)))
        parts.clear()

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not skipped and not in_head:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if in_head and (name not in OF_HEAD or m[1]):
            in_head = in_head and bool(m[1]) and name != "head"
            if m[1]:
                continue
        if name in RAW and not m[1]:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if skipped:
            if m[1]:
                if name in skipped:
                    del skipped[len(skipped) - 1 - skipped[::-1].index(name) :]
                    continue
                if not any(s[0] == name for s in stack):
                    continue
                skipped.clear()
            elif skipped[0] in INLINE and name in OF_PAGE:
                skipped.clear()
            else:
                if name not in VOID and not m[3].endswith("/"):
                    skipped.append(name)
                continue
        if name == "head":
            in_head = not m[1]
            continue
        if name in BLOCKS:
            close()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            continue
        if name in SILENT:
            if not m[3].endswith("/"):
                skipped.append(name)
            continue
        if name == "a":
            links += 1
        if name in VOID or m[3].endswith("/") or name not in BLOCKS and name not in ("span", "a", "section", "label"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):  # a new one ends the one before
            while stack and stack[-1][0] == name:
                stack.pop()
        attributes = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(m[3])}
        named = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
        _, margin, inside, hidden = stack[-1] if stack else ("", 0.0, False, False)
        if name in CONTENT:
            # their own names say little but for comments, which some pages write as articles
            margin = 1.0 if margin == 1 or COMMENTS.intersection(named.lower().split()) else 0.0
            inside = inside or margin == 0
        elif name not in ("body", "html"):
            margin = max(margin, 1.0 if name in MARGINS else named_margin(named) if named.strip() else 0.0)
        hidden = hidden or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))
        stack.append((name, margin, inside, hidden))
    if at < len(page) and not skipped and not in_head:
        parts.append((page[at:], links > 0))
    close()
    return found


def features(found: list[Block]) -> np.ndarray:
    """Words and link density of each block and its neighbours, and where it stands."""
    words = np.array([b.words for b in found], dtype=float)
    density = np.array([b.linked / max(1, b.words) for b in found])
    edge = np.zeros(1)
    return np.column_stack(
        [
            words, density,
            np.concatenate([edge, words[:-1]]), np.concatenate([edge, density[:-1]]),
            np.concatenate([words[1:], edge]), np.concatenate([density[1:], edge]),
            [b.margin for b in found], [b.inside for b in found], [b.heading for b in found],
            [b.text[-1] in ".!?:;\"')…。»" for b in found],
        ]
    ).astype(float)


# Labelled blocks: the numbers of NUMBERS, and whether the block belongs to the main text.
LABELLED = [
    # long paragraphs of articles, with and without a container that says so
    (60, 0.0, 8, 0.0, 45, 0.0, 0, 1, 0, 1, 1), (45, 0.0, 60, 0.0, 70, 0.05, 0, 1, 0, 1, 1), (120, 0.02, 40, 0.0, 3, 0.0, 0, 1, 0, 1, 1),
    (80, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 1, 1), (35, 0.1, 90, 0.0, 40, 0.0, 0, 0, 0, 1, 1), (28, 0.0, 9, 0.0, 70, 0.0, 0, 0, 0, 1, 1),
    (200, 0.01, 6, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (24, 0.04, 30, 0.0, 33, 0.0, 0, 0, 0, 0, 1), (150, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 1),
    # short paragraphs, titles, list items and captions within an article
    (6, 0.0, 0, 0.0, 55, 0.0, 0, 1, 1, 0, 1), (10, 0.0, 4, 1.0, 80, 0.0, 0, 1, 1, 0, 1), (3, 0.0, 60, 0.0, 40, 0.0, 0, 1, 0, 1, 1),
    (1, 0.0, 30, 0.0, 12, 0.0, 0, 1, 0, 0, 1), (5, 0.0, 5, 0.0, 6, 0.0, 0, 1, 0, 0, 1), (2, 0.0, 3, 0.0, 0, 0.0, 0, 1, 0, 1, 1),
    (8, 0.3, 70, 0.0, 65, 0.0, 0, 1, 0, 1, 1), (4, 1.0, 40, 0.0, 50, 0.0, 0, 1, 0, 0, 1), (14, 0.5, 20, 0.0, 20, 0.1, 0, 1, 0, 0, 1),
    (7, 0.0, 80, 0.0, 12, 0.0, 0, 1, 0, 1, 1), (9, 0.0, 2, 1.0, 2, 0.0, 0, 1, 1, 0, 1), (12, 0.0, 0, 0.0, 10, 0.0, 0, 1, 0, 1, 1),
    # the same beside adverts, menus and footers
    (3, 0.0, 12, 0.0, 3, 0.0, 0, 1, 1, 1, 1), (4, 0.0, 9, 0.0, 9, 0.0, 0, 1, 0, 1, 1), (4, 0.0, 4, 0.0, 9, 0.0, 0, 1, 0, 1, 1),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 1), (6, 0.0, 2, 1.0, 7, 1.0, 0, 1, 0, 1, 1), (7, 0.0, 8, 0.0, 1, 1.0, 0, 1, 0, 1, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 1), (5, 0.0, 3, 0.0, 2, 1.0, 0, 1, 0, 0, 1), (1, 1.0, 25, 0.0, 2, 1.0, 0, 1, 0, 0, 1),
    (3, 0.0, 4, 0.0, 4, 0.0, 0, 1, 0, 0, 1), (8, 0.0, 5, 1.0, 3, 0.0, 0, 1, 0, 1, 1),
    (8, 0.0, 1, 1.0, 3, 0.0, 0, 1, 0, 1, 1), (8, 0.0, 2, 0.0, 9, 0.0, 0, 1, 0, 0, 1), (8, 0.0, 0, 0.0, 8, 0.0, 0, 1, 1, 1, 1), (2, 0.0, 2, 0.0, 7, 0.0, 0, 1, 0, 1, 1),
    (30, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 1, 1), (25, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0, 1, 1), (70, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 1, 1),
    (22, 0.0, 1, 0.0, 2, 1.0, 0, 0, 0, 1, 1), (40, 0.0, 2, 0.0, 5, 0.0, 0, 0, 0, 1, 1), (33, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 1),
    (18, 0.0, 5, 1.0, 20, 0.0, 0, 0, 0, 1, 1), (20, 0.1, 3, 1.0, 4, 1.0, 0, 0, 0, 1, 1), (300, 0.05, 2, 1.0, 6, 0.0, 0, 0, 0, 0, 1),
    # titles and short paragraphs between long ones where no container helps
    (7, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1, 0, 1), (9, 0.0, 70, 0.0, 50, 0.0, 0, 0, 1, 0, 1), (8, 0.0, 65, 0.0, 72, 0.0, 0, 0, 0, 1, 1),
    (12, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 1, 1), (6, 0.0, 90, 0.0, 44, 0.0, 0, 0, 0, 1, 1),
    # menus, link lists and bread crumbs
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 8, 0.0, 1, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (6, 1.0, 5, 1.0, 7, 1.0, 0, 0, 0, 0, 0), (9, 0.8, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    (20, 0.9, 4, 1.0, 5, 1.0, 0, 0, 0, 0, 0), (5, 1.0, 60, 0.0, 6, 1.0, 0, 0, 0, 0, 0), (30, 0.7, 10, 0.9, 12, 0.8, 0, 0, 0, 0, 0),
    (3, 1.0, 50, 0.0, 70, 0.0, 0, 0, 0, 0, 0), (4, 1.0, 80, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (15, 1.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 0),
    # adverts, notices, forms, side bars, comments, page headers and footers
    (8, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0, 1, 0), (25, 0.0, 2, 1.0, 9, 0.0, 1, 0, 0, 1, 0), (12, 0.1, 80, 0.0, 0, 0.0, 1, 0, 0, 1, 0),
    (45, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1, 0), (90, 0.0, 50, 0.0, 40, 0.0, 1, 0, 0, 1, 0), (60, 0.05, 12, 0.0, 70, 0.0, 1, 0, 0, 1, 0),
    (4, 0.0, 3, 0.0, 5, 0.0, 1, 0, 0, 0, 0), (15, 0.0, 30, 0.0, 25, 0.0, 1, 1, 0, 1, 0), (40, 0.0, 70, 0.0, 60, 0.0, 1, 1, 0, 1, 0),
    (6, 0.0, 50, 0.0, 45, 0.0, 1, 1, 1, 0, 0), (3, 1.0, 60, 0.0, 50, 0.0, 1, 1, 0, 0, 0), (7, 0.0, 0, 0.0, 2, 1.0, 1, 0, 1, 0, 0),
    # names that say margin in part: text by its words and links, on both sides
    (45, 0.0, 60, 0.0, 50, 0.0, 0.5, 0, 0, 1, 1), (30, 0.05, 9, 0.0, 70, 0.0, 0.5, 0, 0, 1, 1), (90, 0.0, 7, 0.0, 0, 0.0, 0.5, 0, 0, 1, 1), (22, 0.0, 3, 1.0, 40, 0.0, 0.5, 0, 0, 1, 1),
    (60, 0.1, 2, 1.0, 1, 1.0, 0.5, 0, 0, 1, 1), (8, 0.0, 4, 0.0, 65, 0.0, 0.5, 1, 1, 0, 1), (5, 0.0, 40, 0.0, 30, 0.0, 0.5, 1, 0, 1, 1), (35, 0.0, 20, 0.0, 25, 0.0, 0.5, 1, 0, 1, 1),
    (7, 0.0, 0, 0.0, 60, 0.0, 0.5, 0, 1, 0, 1), (12, 0.0, 50, 0.0, 45, 0.0, 0.5, 0, 0, 1, 1),
    (3, 1.0, 2, 1.0, 4, 1.0, 0.5, 0, 0, 0, 0), (6, 0.0, 2, 1.0, 2, 1.0, 0.5, 0, 0, 0, 0), (15, 0.8, 30, 0.0, 3, 1.0, 0.5, 0, 0, 0, 0), (4, 0.0, 3, 0.0, 2, 0.0, 0.5, 0, 0, 0, 0), (5, 1.0, 60, 0.0, 50, 0.0, 0.5, 1, 0, 0, 0),
    (25, 0.9, 10, 1.0, 8, 1.0, 0.5, 0, 0, 1, 0),
    # stray short text without a container: dates, by-lines, rights
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (5, 0.2, 3, 1.0, 0, 0.0, 0, 0, 0, 1, 0),
    (1, 0.0, 0, 0.0, 25, 0.0, 0, 0, 0, 0, 0), (1, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (2, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    (6, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 1, 0), (2, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0, 0), (8, 0.0, 1, 1.0, 4, 0.0, 0, 0, 0, 0, 0),
]


class DecisionTree:
    """A binary tree of thresholds, grown by Gini impurity; ties go to the earlier feature and lower threshold."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 1):
        self.value = float(labels.mean()) if len(labels) else 0.0
        self.split = None
        if depth == 0 or len(labels) < 2 * least or labels.min() == labels.max():
            return
        best = None
        for feature in range(rows.shape[1]):
            values = np.unique(rows[:, feature])
            for threshold in (values[1:] + values[:-1]) / 2:
                low = rows[:, feature] < threshold
                if least <= low.sum() <= len(low) - least:
                    impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (labels[low], labels[~low]))
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, feature, threshold, low)
        if best:
            _, feature, threshold, low = best
            self.split = feature, threshold
            self.below = DecisionTree(rows[low], labels[low], depth - 1, least)
            self.above = DecisionTree(rows[~low], labels[~low], depth - 1, least)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(rows), self.value)
        feature, threshold = self.split
        low = rows[:, feature] < threshold
        return np.where(low, self.below.predict(rows), self.above.predict(rows))


def grow_tree(labelled: list[tuple] = LABELLED) -> DecisionTree:
    table = np.array(labelled, dtype=float)
    return DecisionTree(table[:, :-1], table[:, -1])


def main_blocks(page: str, tree: DecisionTree) -> list[str]:
    found = blocks(page)
    if not found:
        return []
    return [b.text for b, p in zip(found, tree.predict(features(found)), strict=True) if p >= 0.5]


def extract(pages: DataFrame, labelled: list[tuple] = LABELLED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``: the main text of every page, its blocks joined by line feeds.

    A null or empty page has an empty text, as has a page without main text; pages that repeat
    are read each; an empty table gives no rows.  ``labelled`` teaches the tree.
    """
    tree = grow_tree(labelled)
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slim = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(2)], ["row", "html"])
            for rows, texts in sliced(iter([slim])):
                lo = rows[0].as_py()
                text = pa.array(["\n".join(main_blocks(t, tree)) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), batch.column(1).slice(lo, len(rows)), text], ["page_id", "url", "text"])

    kinds = [source.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return map_batches(source, run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
