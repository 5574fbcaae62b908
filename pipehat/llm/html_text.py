"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events. Block starts and ends cut the page into lines; each line knows its characters,
its characters inside links, its tags and its place in the tree. Elements that never hold an article (scripts, styles, forms,
menus, page headers and footers, sidebars, notices, adverts, reader comments) are left out by name, role or class. The
others' text-to-tag ratios, smoothed by a Gaussian, fall into two clusters; the innermost element that holds nine tenths of the
higher cluster's characters, widened while what its parent adds is mostly of that cluster too, is the content region. If an
`<article>` or `<main>` stands around it, that is the region, whole. Else its lines from the first to the last of the cluster are,
with headings, paragraphs and lists that touch them. Links count when the region is chosen; inside it lines of links are text.

White space inside a line becomes one space; lines are joined by one space. Null, empty or textless html gives an empty text
and 0 characters. Rows are independent: ties, repeated rows and null ids pass through. Time and memory grow in proportion to the
page, however deep its elements are nested and however many are left open.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipehat.llm.arrow import map_batches, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements whose text is never an article's.
NEVER = frozenset("script style noscript template head title nav aside form button select textarea input option iframe object svg canvas audio video map dialog menu footer datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class and id names that mark what isn't an article's.
NEVER_NAMES = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar sidenav aside footer foot colophon masthead topbar toolbar "
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored sponsors commercial "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay lightbox newsletter subscribe subscription signup login "
    "social share sharing related recommended recommendations trending comment comments commentlist disqus reply replies respond discussion "
    "pagination pager widget widgets search searchbox form skip hidden disclaimer copyright legal paywall teaser "
    "commentbox commentsection commentarea commentthread commentform noticebox cookiebar cookiebanner adbox adslot adunit sidebox leftbar rightbar navmenu mainmenu topmenu sitemenu pageheader siteheader pagefooter sitefooter".split()
)
#: Beside one of these, `header` names an article's own header.
ARTICLE_NAMES = frozenset("article post entry story content".split())
#: Names of the part that holds the article; they aren't looked up in NEVER_NAMES.
KEEP_ELEMENTS = frozenset(("html", "body", "article", "main"))
#: Words that stand beside those of NEVER_NAMES in a class; a class with any other word says something else.
NEUTRAL = frozenset(
    "area articles bar block body bottom box button buttons card cards column container content count element fixed floating footer global header heading hidden icon "
    "icons inner item items label left link links list main mobile module news outer page panel post posts primary right row secondary section sections site slot stories "
    "sticky strip tab tabs text title toggle top unit user wrap wrapper zone".split()
)
NAME_PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
SPACE = re.compile(r"\s+")
#: Elements that a start tag ends when they stand open: HTML's optional end tags.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which those end tags don't reach.
LISTS = ("ul", "ol", "dl", "table", "menu", "select")
#: Elements that mark an article.
MARKED = frozenset(("article", "main"))
#: The page itself.
ROOTS = frozenset(("", "html", "body"))
#: Children of a region that belong to it at its ends: paragraphs, headings and lists; '' is text of the region itself.
TEXT_BLOCKS = frozenset(("", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "pre", "blockquote", "figure"))
SIGMA, RADIUS = 1.0, 3
KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]


def unwanted(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if tag in KEEP_ELEMENTS:
        return False
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true":
            return True
        if k == "style" and v and "display:none" in v.replace(" ", "").lower():
            return True
        if k == "role" and v and v.strip().lower() in NEVER_ROLES:
            return True
        if k in ("class", "id") and v:
            for name in v.split():
                parts = {x.lower() for x in NAME_PARTS.findall(name)}
                if parts & NEVER_NAMES and parts <= NEVER_NAMES | NEUTRAL or "header" in parts and not in_article and not ARTICLE_NAMES & parts:
                    return True
    return False


class Line:
    __slots__ = ("text", "linked", "tags", "block", "heading")

    def __init__(self, text: str, linked: int, tags: int, block: int, heading: bool):
        self.text, self.linked, self.tags, self.block, self.heading = text, linked, tags, block, heading

    @property
    def ratio(self) -> float:
        return max(0, len(self.text) - 2 * self.linked) / max(1, self.tags)


class Lines(HTMLParser):
    """Collects the lines of a page, and of its block elements, numbered from 1 as they begin, tags, parents and last members."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool]] = []  # tag, whether it's left out
        self.at: dict[str, list[int]] = defaultdict(list)  # places in the stack of each open tag
        self.blocks: list[tuple[int, int]] = []  # (place in the stack, number) of open blocks
        self.tag, self.parent, self.last = [""], [0], [0]
        self.buffer: list[str] = []
        self.linked = self.tags = self.links = self.articles = self.out = self.heads = 0

    def cut(self) -> None:
        if self.buffer:
            text = SPACE.sub(" ", "".join(self.buffer)).strip()
            if text:
                self.lines.append(Line(text, self.linked, self.tags, self.blocks[-1][1] if self.blocks else 0, self.heads > 0))
                self.tags = 0
            self.buffer, self.linked = [], 0

    def push(self, tag: str, left_out: bool) -> None:
        if tag in BLOCK:
            self.blocks.append((len(self.stack), len(self.tag)))
            self.parent.append(self.blocks[-2][1] if len(self.blocks) > 1 else 0)
            self.last.append(len(self.tag))
            self.tag.append(tag)
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, left_out))
        self.out += left_out
        self.links += tag == "a"
        self.heads += tag in HEADINGS
        self.articles += tag in MARKED

    def pop_to(self, place: int) -> None:
        """End the element at that place of the stack and all inside it."""
        while len(self.stack) > place:
            tag, left_out = self.stack.pop()
            self.at[tag].pop()
            self.out -= left_out
            self.links -= tag == "a"
            self.heads -= tag in HEADINGS
            self.articles -= tag in MARKED
            if tag in BLOCK:
                self.last[self.blocks.pop()[1]] = len(self.tag) - 1

    def open_at(self, tags: Iterable[str]) -> int:
        """Place in the stack of the innermost open element of these tags, -1 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.buffer.append(" ")
            self.tags += 1
            return
        if tag in BLOCK:
            self.cut()
            if self.blocks and self.stack[self.blocks[-1][0]][0] == "p":  # a paragraph holds no block
                self.pop_to(self.blocks[-1][0])
        if tag in CLOSES:
            place = self.open_at(CLOSES[tag])
            if place > self.open_at(LISTS):
                self.pop_to(place)
        self.tags += 1
        if tag == "body":  # a head that was never ended holds nothing of the body
            for t in ("head", "title"):
                if self.at.get(t):
                    self.pop_to(self.at[t][0])
        if tag not in VOID:
            self.push(tag, unwanted(tag, attrs, self.articles > 0))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "rect", "circle", "line", "use", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        place = self.open_at((tag,))
        # an inline end tag never ends a block
        if place >= 0 and (tag in BLOCK or not self.blocks or place > self.blocks[-1][0]):
            self.pop_to(place)

    def handle_data(self, data: str) -> None:
        if self.out:
            return
        self.buffer.append(data)
        if self.links:
            self.linked += len(data.strip())

    def finish(self) -> None:
        self.close()
        self.cut()
        self.pop_to(0)


def smooth(values: list[float]) -> np.ndarray:
    """Gaussian means; at the ends the kernel is cut and weighed anew."""
    n = len(values)
    middle = slice(RADIUS, RADIUS + n)
    return np.convolve(values, KERNEL)[middle] / np.convolve(np.ones(n), KERNEL)[middle]


def threshold(values: np.ndarray) -> float:
    """Half way between the means of two clusters on a log scale."""
    logs = np.log1p(values)
    lo, hi = logs.min(), logs.max()
    if hi - lo < 1e-9:
        return float(np.min(values))
    for _ in range(50):
        high = logs >= (lo + hi) / 2
        new = (logs[~high].mean() if not high.all() else lo, logs[high].mean() if high.any() else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    return float(np.expm1((lo + hi) / 2))


def region(page: Lines) -> list[Line]:
    """The lines of the content region."""
    lines, parent = page.lines, page.parent
    if not lines:
        return []
    ratios = smooth([x.ratio for x in lines])
    cut = threshold(ratios) - 1e-9
    prose = [i for i, x in enumerate(lines) if 2 * x.linked <= len(x.text)]
    picked = set([i for i in prose if ratios[i] >= cut] or prose or [i for i, x in enumerate(lines) if in_marked(page, x.block)])
    if not picked:
        return []
    # characters, and those of the cluster, below each block; a line's own block holds but itself, unless it's marked
    held, of_cluster = [0] * len(parent), [0] * len(parent)
    for i, x in enumerate(lines):
        at = x.block if page.tag[x.block] in MARKED else parent[x.block]
        held[at] += len(x.text)
        of_cluster[at] += len(x.text) * (i in picked)
    for k in range(len(parent) - 1, 0, -1):
        held[parent[k]] += held[k]
        of_cluster[parent[k]] += of_cluster[k]
    holder = max((k for k in range(1, len(parent)) if 10 * of_cluster[k] >= 9 * of_cluster[0]), default=0)
    while page.tag[parent[holder]] not in ROOTS and 2 * (of_cluster[parent[holder]] - of_cluster[holder]) >= held[parent[holder]] - held[holder]:
        holder = parent[holder]
    marked = in_marked(page, holder)
    if marked:
        holder = marked
    low, high = holder, page.last[holder] if holder else len(parent)
    inside = [i for i, x in enumerate(lines) if low <= x.block <= high]
    if not marked:
        child = children(page, holder)
        chosen = [n for n, i in enumerate(inside) if i in picked]
        first, last = chosen[0], chosen[-1]
        touches = lambda x: x.heading or child[x.block] in TEXT_BLOCKS and 2 * x.linked <= len(x.text)
        while first > 0 and touches(lines[inside[first - 1]]):
            first -= 1
        while last < len(inside) - 1 and touches(lines[inside[last + 1]]):
            last += 1
        inside = inside[first : last + 1]
        if first == 0:  # the headings right before the element are its own
            while inside[0] > 0 and lines[inside[0] - 1].heading and not in_marked(page, lines[inside[0] - 1].block):
                inside.insert(0, inside[0] - 1)
    return [lines[i] for i in inside]


def in_marked(page: Lines, block: int) -> int:
    """The innermost marked element around the block, itself included; 0 without one."""
    while block and page.tag[block] not in MARKED:
        block = page.parent[block]
    return block


def children(page: Lines, holder: int) -> list[str]:
    """For each block the tag of the holder's child that it lies in; '' for the holder itself and what is outside."""
    out = [""] * len(page.tag)
    for k in range(holder + 1, (page.last[holder] if holder else len(page.tag) - 1) + 1):
        out[k] = page.tag[k] if page.parent[k] == holder else out[page.parent[k]]
    return out


def main_text(html: str | None) -> str:
    """The page's main text; '' if it has none."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    return " ".join(x.text for x in region(page))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each row its id, url, text and n_chars (code points)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in slices(batches, 2):
            texts = [main_text(x) for x in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")]
    return map_batches(df, columns, work, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
