"""Main text of web pages by shallow text features.

A page is cut into flat text blocks at block-level tags. Each block is described by its words and link density, those of
the blocks before and after it, and whether it stands inside an article or inside a named side part of the page. A
decision tree trained on the small labelled table below says which blocks are content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements that begin and end blocks, whose text is never shown, or that are side parts.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript "
                   "ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style template noscript head title select option textarea button svg iframe object".split())
SIDES = frozenset("nav header footer aside form menu dialog".split())
SIDE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
                       "cookie cookies disclaimer footer header menu nav navbar navigation newsletter notice pager popup "
                       "promo related reply share sharing sidebar social sponsor sponsored subscribe toolbar "
                       "widget".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "side")
#: Labelled blocks: the features in order (link densities in per cent), and 1 for content.
LABELLED = [
    # paragraphs and headings inside an article
    (80, 0, 60, 0, 55, 0, 1, 0, 1), (45, 0, 9, 0, 70, 0, 1, 0, 1), (9, 0, 6, 0, 45, 0, 1, 0, 1), (1, 0, 50, 0, 33, 0, 1, 0, 1),
    (2, 0, 44, 0, 8, 0, 1, 0, 1), (5, 0, 1, 100, 40, 0, 1, 0, 1), (33, 12, 50, 0, 20, 0, 1, 0, 1), (12, 40, 61, 0, 48, 0, 1, 0, 1),
    (8, 0, 1, 100, 12, 0, 1, 0, 1), (27, 0, 30, 0, 11, 10, 1, 0, 1), (3, 0, 3, 0, 3, 0, 1, 0, 1), (150, 2, 0, 0, 0, 0, 1, 0, 1),
    (11, 0, 8, 0, 10, 5, 1, 0, 1), (6, 100, 40, 0, 35, 0, 1, 0, 1), (4, 75, 30, 0, 60, 0, 1, 0, 1),
    (8, 0, 2, 100, 12, 0, 1, 0, 1), (6, 0, 3, 100, 30, 0, 1, 0, 1), (40, 0, 50, 0, 5, 100, 1, 0, 1), (12, 0, 70, 0, 10, 60, 1, 0, 1),
    (3, 100, 3, 100, 3, 100, 1, 0, 1), (60, 0, 4, 100, 2, 100, 1, 0, 1), (2, 0, 1, 100, 4, 100, 1, 0, 1), (1, 0, 2, 100, 2, 100, 1, 0, 1),
    # side parts inside an article: shares, related links, adverts, comments
    (3, 100, 40, 0, 4, 100, 1, 1, 0), (9, 0, 60, 0, 35, 0, 1, 1, 0), (25, 0, 70, 0, 18, 0, 1, 1, 0), (14, 20, 9, 0, 50, 0, 1, 1, 0),
    (60, 0, 80, 0, 12, 0, 1, 1, 0), (1, 0, 30, 0, 30, 0, 1, 1, 0),
    # menus, adverts, notices and footers
    (1, 100, 0, 0, 1, 100, 0, 1, 0), (1, 100, 1, 100, 1, 100, 0, 1, 0), (2, 100, 1, 100, 8, 0, 0, 1, 0), (8, 0, 1, 100, 9, 0, 0, 1, 0),
    (7, 0, 2, 100, 5, 0, 0, 1, 0), (10, 10, 55, 0, 0, 0, 0, 1, 0), (12, 0, 40, 0, 0, 0, 0, 1, 0), (30, 0, 3, 100, 9, 0, 0, 1, 0),
    (45, 5, 60, 0, 20, 0, 0, 1, 0), (90, 0, 12, 0, 80, 0, 0, 1, 0), (3, 0, 1, 100, 30, 0, 0, 1, 0), (16, 50, 30, 0, 4, 100, 0, 1, 0),
    # pages without an article element: long blocks with few links are content, lists of links and stray lines aren't
    (60, 0, 8, 0, 45, 0, 0, 0, 1), (35, 3, 70, 0, 50, 2, 0, 0, 1), (120, 1, 5, 90, 3, 100, 0, 0, 1), (18, 0, 50, 0, 44, 0, 0, 0, 1),
    (11, 0, 30, 0, 60, 0, 0, 0, 1), (7, 0, 42, 0, 66, 0, 0, 0, 1), (22, 10, 40, 0, 2, 100, 0, 0, 1), (28, 0, 6, 0, 20, 0, 0, 0, 1),
    (1, 100, 1, 100, 1, 100, 0, 0, 0), (2, 100, 0, 0, 3, 100, 0, 0, 0), (5, 80, 2, 100, 6, 70, 0, 0, 0), (20, 90, 4, 100, 7, 100, 0, 0, 0),
    (40, 75, 50, 80, 30, 60, 0, 0, 0), (4, 0, 2, 100, 1, 100, 0, 0, 0), (3, 0, 1, 100, 2, 100, 0, 0, 0), (6, 0, 3, 100, 0, 0, 0, 0, 0),
    (9, 60, 40, 0, 8, 55, 0, 0, 0), (2, 0, 3, 100, 5, 0, 0, 0, 0),
]


def train_tree(rows: list[tuple], depth: int = 5, least: int = 2) -> tuple:
    """A binary tree ``(feature, threshold, below, from)`` with leaves ``(label,)``, by Gini impurity; ties go to the
    feature listed first and the lower threshold."""
    ones = sum(r[-1] for r in rows)
    leaf = (int(2 * ones >= len(rows)),)
    if depth == 0 or ones in (0, len(rows)):
        return leaf

    def impurity(part: list[tuple]) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)
    best = (impurity(rows) - 1e-9, None, None)
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            below, above = [r for r in rows if r[f] < cut], [r for r in rows if r[f] >= cut]
            if min(len(below), len(above)) >= least and (cost := impurity(below) + impurity(above)) < best[0]:
                best = (cost, f, cut)
    if best[1] is None:
        return leaf
    _, f, cut = best
    return (f, cut, train_tree([r for r in rows if r[f] < cut], depth - 1, least),
            train_tree([r for r in rows if r[f] >= cut], depth - 1, least))


def decide(tree: tuple, row: tuple) -> int:
    while len(tree) > 1:
        tree = tree[3] if row[tree[0]] >= tree[1] else tree[2]
    return tree[0]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    side: bool


class _Blocks(HTMLParser):
    """Flat blocks of a page in order; elements left open end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parts: list[tuple[str, bool]] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, hides, article, side
        self.links = 0

    def _flush(self) -> None:
        text = " ".join("".join(t for t, _ in self.parts).split(None))
        if text:
            linked = sum(len(t.split()) for t, link in self.parts if link)
            self.blocks.append(Block(text, len(text.split(" ")), linked, any(x[2] for x in self.open),
                                     any(x[3] for x in self.open)))
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append((" ", False))
        if tag in VOID and tag != "hr":
            return
        if tag in BLOCKS or tag in HIDDEN:
            self._flush()
            self.links = 0  # a link left open ends with its block
        if tag == "a":
            self.links += 1
        elif tag not in VOID and (tag in HIDDEN or tag in BLOCKS):
            if tag in ("p", "li", "option", "dt", "dd", "td", "th", "tr"):
                return  # often left open, and they don't tell anything
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            side = tag in SIDES or not SIDE_WORDS.isdisjoint(re.split(r"[^a-z]+", named.lower()))
            if tag in ("body", "html", "article", "main"):
                side = False
            self.open.append((tag, tag in HIDDEN, tag in ("article", "main"), side))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in HIDDEN:
            self._flush()
            if any(x[0] == tag for x in self.open):
                while self.open.pop()[0] != tag:
                    pass
        elif tag == "a":
            self.links = max(0, self.links - 1)

    def handle_data(self, data: str) -> None:
        if not any(x[1] for x in self.open):
            self.parts.append((data, self.links > 0))


def blocks_of(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser.blocks


def main_text(html: str, tree: tuple) -> str:
    """Content blocks in page order, one a line."""
    blocks = blocks_of(html)
    shape = [(b.words, 100 * b.linked / b.words) for b in blocks]
    edge = (0, 0.0)
    kept = []
    for i, b in enumerate(blocks):
        before, after = shape[i - 1] if i else edge, shape[i + 1] if i + 1 < len(blocks) else edge
        if decide(tree, (*shape[i], *before, *after, int(b.article), int(b.side))):
            kept.append(b.text)
    return "\n".join(kept)


def _extract(tree: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, labelled: list[tuple] | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``, from the whole html.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one newline.
    Null and empty html, and pages without content, give an empty text. Broken markup is read as far as it goes.
    Repeated rows give repeated rows, an empty table none; further columns are ignored.
    """
    tree = train_tree(list(labelled or LABELLED))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")) \
        .mapInArrow(_extract(tree), f"page_id {kind}, url string, text string, n_chars long")
