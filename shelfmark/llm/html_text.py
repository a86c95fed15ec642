"""Main text of web pages from flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. Each block is described by its word count and link density, those
of its neighbours, and whether a tag or a class name around it speaks for the main text or for page furniture, for sure or
as words that articles use as well. A small
tree, trained on a small labelled table of blocks, tells which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import arrow_map, record_batch, slices

#: Tags whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "textarea", "title", "head", "select", "annotation", "annotation-xml", "audio", "video"}
#: Tags that stay within a block; any other tag ends it.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | {"math", "semantics", "annotation", "annotation-xml", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "merror", "menclose", "mfenced"}
#: Tags without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags around page furniture; header only outside of the main text.
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
MAIN = {"article", "main"}
#: Words in a class, id or role that speak for page furniture, for reader comments among them. Whole words only: open stems
#: would meet the words of articles.
_FURNITURE = (
    "ads? advert adverts advertisements? advertising adsense sponsor sponsors sponsored promos? promotions? promotional cookies? consent gdpr "
    "comments? replies disqus sidebar nav navbar navigation navmenu breadcrumbs? footer masthead topbar toolbar sharing newsletter subscribe "
    "subscription signup popup modal overlay pagination pager complementary contentinfo"
).replace(" ", "|")
FURNITURE_WORDS = re.compile(rf"(?:^|[\s_-])(?:{_FURNITURE})(?:$|[\s_-])", re.I)
#: The same as a whole name.
FURNITURE_NAME = re.compile(rf"(?:^|\s)(?:{_FURNITURE})(?:$|\s)", re.I)
#: Tags that hold parts of a page, which names within the main element are believed of.
CONTAINERS = {"div", "section", "ul", "ol", "table", "center"}
#: Words that name parts of articles as well; they are only a feature of the block.
DOUBTFUL_WORDS = re.compile(
    r"(?:^|[\s_-])(?:banner|notice|alert|respond|side|widget|menu|foot|header|share|social|related|recommend|recommended|recommendations|"
    r"login|search|copyright|legal|skip|dialog)(?:$|[\s_-])",
    re.I,
)
#: Around what readers write, which may be articles of its own.
COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|disqus|respond)(?:$|[\s_-])", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|body|main|text)(?:$|[\s_-])", re.I)

# a comment may end at once: <!--> and <!---> are whole ones
_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>="']+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"']*)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
# tags that a following tag of the same kind closes
_ALONE = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    main: bool
    doubtful: int = 0

    @property
    def links(self) -> float:
        return self.linked / self.words if self.words else 0.0


def attributes_of(raw: str) -> dict[str, str]:
    """The attributes of a tag by name in lower case; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NONE.search(attributes.get("style", "")))


@dataclass(frozen=True)
class Around:
    """What an open tag and all around it say of their text: a tag of page furniture, names of furniture, of comments, how
    doubtful names make it, a main element.

    Outside of a main element a name of furniture is believed. Within one it only makes the block doubtful: 2 for a whole
    name of a container, 1 for any other; ids are left out there, as they are slugs of the words."""

    tag: str = ""
    fixed: bool = False
    named: bool = False
    comments: bool = False
    doubtful: int = 0
    main: bool = False

    def within(self, tag: str, raw: str) -> Around:
        attributes = attributes_of(raw)
        fixed = self.fixed or tag in FURNITURE or (tag == "header" and not self.main) or is_hidden(attributes)
        if tag in MAIN and not self.main and not self.comments:  # names of wrappers say nothing of the main element in them
            return Around(tag, fixed, False, False, 0, not fixed)
        slug = tag in _HEADINGS or self.main
        names = " ".join(attributes.get(k, "") for k in ("class", "role", "aria-label", *(() if slug else ("id",)))).strip()
        read = bool(names) and tag not in MAIN and tag not in ("body", "html")
        furniture = read and bool(FURNITURE_WORDS.search(names))
        level = int(furniture or (read and bool(DOUBTFUL_WORDS.search(names))))
        if self.main and furniture and tag in CONTAINERS and FURNITURE_NAME.search(f"{attributes.get('class', '')} {attributes.get('role', '')}"):
            level = 2
        named = self.named or (furniture and not self.main)
        doubtful = max(self.doubtful, level)
        comments = self.comments or (read and (level == 2 or not self.main) and bool(COMMENT_WORDS.search(names)))
        main = tag in MAIN or bool(names and tag in ("div", "section") and MAIN_WORDS.search(names))
        return Around(tag, fixed, named, comments, doubtful, self.main or (main and not fixed and not named and not (doubtful and tag not in MAIN)))


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page, in order. Broken markup is taken as browsers do, as far as blocks go."""
    out: list[Block] = []
    open_: list[Around] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link = False

    def finish() -> None:
        text = " ".join("".join(parts).split())
        if text:
            at_ = open_[-1] if open_ else Around()
            out.append(Block(text, len(text.split()), len(" ".join(linked).split()), at_.fixed or at_.named, at_.main, at_.doubtful))
        parts.clear()
        linked.clear()

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        piece = html.unescape(page[at : m.start() if m else n])
        if piece:
            parts.append(piece)
            if in_link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            if tag in INLINE:
                continue
            finish()
            for i in range(len(open_) - 1, -1, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
            continue
        if tag in SILENT:
            if tag not in INLINE:
                finish()
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag not in ("head", "title"):
                    at = n
            continue
        if tag == "a":
            in_link = True
        if tag in INLINE:
            continue
        finish()
        if tag in VOID:
            continue
        in_link = False
        if tag in _ALONE and open_ and open_[-1].tag == tag:
            open_.pop()
        open_.append((open_[-1] if open_ else Around()).within(tag, m[3] or ""))
    finish()
    return out


#: The labelled table: words and link density of the block before, of the block and of the one after it, whether it
#: is in page furniture, in a main element, and whether it is main text. Typical blocks of invented pages.
_PLAIN = [
    # menus and link lists
    (0, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (1, 1.0, 2, 1.0, 9, 0.0, 1, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0),
    (60, 0.0, 4, 1.0, 5, 1.0, 0, 0, 0), (5, 1.0, 6, 0.9, 5, 1.0, 0, 0, 0), (12, 0.8, 9, 0.7, 11, 0.8, 0, 0, 0),
    (4, 1.0, 5, 1.0, 4, 1.0, 1, 1, 0), (80, 0.0, 3, 1.0, 3, 1.0, 1, 1, 0),
    # adverts, notices, forms, footers, comments
    (1, 1.0, 6, 0.0, 9, 0.0, 1, 0, 0), (1, 1.0, 25, 0.0, 8, 0.0, 1, 0, 0), (30, 0.0, 14, 0.1, 0, 0.0, 1, 0, 0),
    (45, 0.0, 5, 0.0, 0, 0.0, 1, 0, 0), (90, 0.0, 60, 0.0, 7, 0.2, 1, 0, 0), (20, 0.0, 110, 0.0, 15, 0.0, 1, 0, 0),
    (50, 0.0, 35, 0.0, 40, 0.0, 1, 1, 0), (70, 0.0, 12, 0.0, 22, 0.0, 1, 1, 0), (3, 0.0, 2, 0.0, 1, 0.0, 1, 1, 0),
    (0, 0.0, 18, 0.2, 3, 1.0, 1, 0, 0), (6, 0.0, 200, 0.0, 2, 0.0, 1, 0, 0),
    # headings, paragraphs and lists of the main text, short ones too
    (6, 0.0, 9, 0.0, 70, 0.0, 0, 1, 1), (9, 0.0, 80, 0.0, 65, 0.0, 0, 1, 1), (80, 0.0, 1, 0.0, 60, 0.0, 0, 1, 1),
    (1, 0.0, 55, 0.02, 2, 0.0, 0, 1, 1), (55, 0.0, 2, 0.0, 12, 0.0, 0, 1, 1), (2, 1.0, 4, 0.0, 30, 0.0, 0, 1, 1),
    (40, 0.0, 30, 0.3, 35, 0.0, 0, 1, 1), (12, 0.0, 3, 1.0, 50, 0.0, 0, 1, 1), (0, 0.0, 7, 0.0, 0, 0.0, 0, 1, 1),
    (30, 0.0, 6, 0.5, 8, 0.0, 0, 1, 1), (8, 0.0, 2, 1.0, 3, 1.0, 0, 1, 1), (300, 0.0, 250, 0.0, 5, 0.0, 0, 1, 1),
    # pages without a main element
    (3, 1.0, 45, 0.0, 50, 0.0, 0, 0, 1), (45, 0.0, 60, 0.05, 38, 0.0, 0, 0, 1), (60, 0.0, 20, 0.0, 4, 1.0, 0, 0, 1),
    (5, 0.0, 33, 0.1, 3, 1.0, 0, 0, 1), (50, 0.0, 8, 0.0, 55, 0.0, 0, 0, 1), (0, 0.0, 24, 0.0, 31, 0.0, 0, 0, 1),
    (4, 1.0, 7, 0.0, 48, 0.0, 0, 0, 1), (40, 0.0, 3, 0.0, 33, 0.0, 0, 0, 1), (3, 1.0, 4, 0.0, 2, 1.0, 0, 0, 0),
    (2, 1.0, 5, 0.0, 3, 0.0, 0, 0, 0), (4, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0), (2, 0.0, 6, 0.0, 1, 1.0, 0, 0, 0),
]
#: Blocks with a doubtful name, in any neighbourhood: words, link density, whether in a main element, and whether main text.
_DOUBTFUL = [
    # parts of the main text that are called like furniture, headings among them; lists of links in it
    (3, 0.0, 1, 1), (15, 0.0, 1, 1), (40, 0.02, 1, 1), (25, 0.2, 1, 1), (90, 0.0, 1, 1), (3, 1.0, 1, 0), (9, 0.8, 1, 0), (40, 0.9, 1, 0),
    # outside of it: notices and boxes, and long texts
    (5, 0.0, 0, 0), (14, 0.1, 0, 0), (30, 0.0, 0, 0), (45, 0.0, 0, 0), (4, 1.0, 0, 0), (100, 0.9, 0, 0), (80, 0.02, 0, 1), (120, 0.0, 0, 1),
]
#: Blocks of the main element in a container with a whole name of furniture: adverts, boxes and what readers write; very long
#: texts are taken for the page's own.
_NAMED = [
    (2, 0.0, 1, 0), (5, 0.0, 1, 0), (14, 0.1, 1, 0), (30, 0.0, 1, 0), (45, 0.0, 1, 0), (90, 0.0, 1, 0), (150, 0.0, 1, 0), (4, 1.0, 1, 0),
    (100, 0.9, 1, 0), (300, 0.0, 1, 1), (400, 0.02, 1, 1),
]
_NEIGHBOURS = [((0, 0.0), (0, 0.0)), ((4, 1.0), (3, 1.0)), ((70, 0.0), (60, 0.0)), ((70, 0.0), (3, 1.0)), ((3, 1.0), (60, 0.0)), ((8, 0.0), (5, 0.0))]
_DOUBTFUL, _NAMED = (
    [(*before, n, links, *after, 0, main, good) for n, links, main, good in rows for before, after in _NEIGHBOURS] for rows in (_DOUBTFUL, _NAMED)
)
LABELLED = [(*r[:-1], doubtful, r[-1]) for doubtful, rows in enumerate((_PLAIN, _DOUBTFUL, _NAMED)) for r in rows]


def grow(rows: list[tuple], depth: int = 6, least: int = 1):
    """A binary tree (feature, threshold, below, above) with 0 or 1 as leaves, grown by Gini impurity."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def gini(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return 2 * p * (1 - p) * len(part)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            below, above = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            if min(len(below), len(above)) >= least:
                loss = gini(below) + gini(above)
                if best is None or loss < best[0] - 1e-12:
                    best = loss, f, cut, below, above
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut, below, above = best
    return f, cut, grow(below, depth - 1, least), grow(above, depth - 1, least)


@lru_cache(maxsize=1)
def default_tree():
    """Blocks with a doubtful name have a tree of their own below the root, so that few rows do not blur the others."""
    plain, doubtful, named = (grow([r for r in LABELLED if r[-2] == d]) for d in (0, 1, 2))
    level = len(LABELLED[0]) - 2
    return level, 0.5, plain, (level, 1.5, doubtful, named)


def decide(tree, features: tuple) -> int:
    while isinstance(tree, tuple):
        f, cut, below, above = tree
        tree = below if features[f] <= cut else above
    return tree


def described(found: list[Block]) -> Iterator[tuple]:
    """The features of each block of a page."""
    none = Block("", 0, 0, False, False)
    for before, b, after in zip([none, *found], found, [*found[1:], none]):
        yield before.words, before.links, b.words, b.links, after.words, after.links, int(b.furniture), int(b.main), int(b.doubtful)


def main_text(page: str, tree=None) -> str:
    """The main blocks of a page, one to a line; empty if there are none."""
    tree, found = tree or default_tree(), blocks(page)
    return "\n".join(b.text for b, f in zip(found, described(found)) if decide(tree, f))


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree=None) -> DataFrame:
    """page_id, url, text and n_chars of every row. A null or empty page has an empty text; rows stay as they are."""
    tree = tree or default_tree()

    def run(batches):
        for b in slices(batches):
            found = [main_text(page or "", tree) for page in b.column(2).to_pylist()]
            yield record_batch(TEXTS, b.column(0), b.column(1), found, [len(t) for t in found])

    columns = [F.col(f"`{c}`").alias(n) for c, n in ((id_col, "page_id"), (url_col, "url"), (html_col, "html"))]
    return arrow_map(pages.select(*columns), run, "page_id long, url string, text string, n_chars long")
