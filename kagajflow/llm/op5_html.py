"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block. Lines of menus, headers, footers, sidebars, notices, adverts, forms, scripts
and reader comments count as empty, and so do those that are links for the most part. The length of a line and of the next two are
summed; at a line with text where the sum surges the main text begins, where the sums dive to nothing it ends, and all lines between
are kept. This decides on every page. Where a page marks an article, the mark weighs the lines: if the largest line block stands
inside, each marked line surges by itself and lines outside count as empty; if it stands outside (teasers marked as articles beside
an unmarked body), the mark weighs nothing. Comments are known by words in class or id, or by their structure in any language: an article
within an article, and siblings of the same tag and class of which two or more hold both a time and a link or picture of who wrote them. A page without any surge gives all lines that count.

Null and empty html give an empty text. Repeated rows are kept, an empty table gives none, only the named columns are read.
Broken markup is read as browsers do in the main: unclosed tags end with their parents, a raw element without end takes the rest,
a tag without end drops it; where quotes don't close, they no longer count. Reading is linear in the page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SURGE = 3, 86
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
#: Elements, roles and words in class or id that mark what isn't main text.
ASIDE = frozenset("nav footer aside form button select dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer header masthead topbar toolbar "
    "share sharing social related recommended comments comment commentlist respond reply replies disqus discussion pagination pager copyright "
    "kommentar kommentare commentaire commentaires comentario comentarios commenti reacties kommentarer komentarze feedback".split()
)
MAIN_WORDS = frozenset("article content entry post story main body text page".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]+))?""", re.I)
CLASS = re.compile(r"""(?<![\w-])class\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]+)""", re.I)
BLANK = re.compile(r"\s+")
CLOSES = {k: frozenset((k,)) for k in ("li", "option", "p", "dd", "dt", "tr", "td", "th")} | {"dd": frozenset(("dd", "dt")), "dt": frozenset(("dd", "dt")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th"))}


def is_aside(name: str, attributes: str, in_main: bool) -> bool:
    if name in ASIDE or name == "header" and not in_main:
        return True
    if not attributes:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" and not value or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for one in value.split():
                parts = [p for p in re.split(r"[^a-z0-9]+", one) if p]
                if one in WORDS or name != "article" and not MAIN_WORDS.intersection(parts) and WORDS.intersection(parts) or {"comments", "comment", "ad", "ads"}.intersection(parts):
                    return True
    return False


@dataclass
class Opened:
    """An open tag: whether it starts what isn't main text, its first line, what it looks like, and what of a comment it has seen."""

    name: str
    aside: bool
    first: int
    look: str
    timed: bool = False
    signed: bool = False
    posts: dict[str, list[tuple[int, int]]] = field(default_factory=dict)  # by look, the lines of the children that may be comments


class Lines:
    """The blocks of a page: (text, aside, in an article, length outside links) of each line."""

    def __init__(self) -> None:
        self.out: list[tuple[str, bool, bool, int]] = []
        self.open_tags: list[Opened] = []
        self.opened: Counter[str] = Counter()
        self.comments: list[tuple[int, int]] = []  # their lines
        self.asides = self.linked = 0
        self.parts: list[str] = []

    @property
    def in_main(self) -> bool:
        return self.opened["article"] + self.opened["main"] > 0

    def text(self, part: str) -> None:
        self.parts.append(part)
        if self.opened["a"]:
            self.linked += len(part)

    def end_line(self) -> None:
        line = BLANK.sub(" ", html.unescape("".join(self.parts))).strip()
        if line:
            self.out.append((line, self.asides > 0, self.in_main, max(0, len(line) - self.linked)))
        self.parts.clear()
        self.linked = 0

    def pop(self) -> str:
        tag = self.open_tags.pop()
        self.asides -= tag.aside
        self.opened[tag.name] -= 1
        self.comments += [p for posts in tag.posts.values() if len(posts) > 1 for p in posts]
        if self.open_tags:
            up = self.open_tags[-1]
            up.timed |= tag.timed or tag.name == "time"
            up.signed |= tag.signed or tag.name == "a"
            if tag.timed and tag.signed and tag.name not in INLINE and tag.name not in ("p", "header", "footer"):
                up.posts.setdefault(tag.look, []).append((tag.first, len(self.out)))
        return tag.name

    def open(self, name: str, attributes: str) -> None:
        tags = self.open_tags
        if name in CLOSES and tags and tags[-1].name in CLOSES[name]:
            self.pop()
        elif name not in INLINE:  # a block ends the paragraph that it stands in
            nearest = next((x.name for x in reversed(tags[-4:]) if x.name not in INLINE), None)
            while nearest == "p" and self.pop() != "p":
                pass
        aside = is_aside(name, attributes, self.in_main) or name == "article" and self.opened["article"] > 0
        look = CLASS.search(attributes)
        tags.append(Opened(name, aside, len(self.out), f"{name} {look[1] if look else ''}"))
        self.asides += aside
        self.opened[name] += 1

    def close(self, name: str) -> None:
        if self.opened[name]:
            while self.pop() != name:
                pass


def raw_end(page: str, name: str, at: int) -> int:
    """Behind the end tag of a raw element."""
    m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
    end = page.find(">", m.end()) if m else -1
    return end + 1 if end >= 0 else len(page)


def lines_of(page: str) -> list[tuple[str, bool, bool, int]]:
    """(text, aside, in an article, length outside links) of each block, in one pass over the page."""
    lines, tag = Lines(), TAG
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            lines.text(page[at : lt if lt >= 0 else n])
        if lt < 0:
            break
        if page.startswith(("<!", "<?"), lt):
            stop = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(stop, lt + len(stop) + 1 if stop != ">" else lt)
            at = end + len(stop) if end >= 0 else n
            continue
        if not (page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/" and page[lt + 2 : lt + 3].isalpha()):
            lines.text("<")
            at = lt + 1
            continue
        if lt > last:  # a tag without end
            break
        m = tag.match(page, lt)
        if not m and tag is TAG:
            tag = LOOSE_TAG
            m = tag.match(page, lt)
        if not m:  # no letter of ASCII begins it
            lines.text("<")
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if name == "br":
            lines.text(" ")
        elif name not in INLINE:
            lines.end_line()
        if m[1]:
            lines.close(name)
        elif name in RAW:
            at = raw_end(page, name, at)
        elif name not in VOID:
            lines.open(name, m[3])
        elif name == "img" and lines.open_tags:
            lines.open_tags[-1].signed = True
    lines.end_line()
    while lines.open_tags:
        lines.pop()
    depth = [0] * (len(lines.out) + 1)
    for a, b in lines.comments:
        depth[a] += 1
        depth[b] -= 1
    return [(line, aside or n > 0, main, free) for (line, aside, main, free), n in zip(lines.out, accumulate(depth), strict=False)]


def blocks_of(lengths: list[int]) -> list[tuple[int, int]]:
    """The line blocks: ranges of lines from a surge, or the lines with text right before it, to behind the last one before the sums dive to nothing."""
    padded, out = lengths + [0] * WINDOW, []
    start = -1
    for i, n in enumerate(lengths):
        total = sum(padded[i : i + WINDOW])
        if start < 0 and n and total > SURGE:
            start = i
            while start > max(0, i - WINDOW) and lengths[start - 1]:
                start -= 1
        elif start >= 0 and not total:
            out.append((start, i))
            start = -1
    if start >= 0:
        out.append((start, len(lengths)))
    return [(a, next(i for i in range(b, a, -1) if lengths[i - 1])) for a, b in out]


def largest(lengths: list[int]) -> int:
    return max((sum(lengths[a:b]) for a, b in blocks_of(lengths)), default=0)


def main_text(page: str) -> str:
    lines = lines_of(page)
    lengths = [free if not aside and 2 * free >= len(line) else 0 for line, aside, _, free in lines]
    marked, heeded = [main and not aside for _, aside, main, _ in lines], False
    if any(marked):
        inside, outside = ([n if main == side else 0 for n, main in zip(lengths, marked, strict=True)] for side in (True, False))
        if largest(inside) >= largest(outside):
            lengths, heeded = [(SURGE + len(line)) * main for (line, *_), main in zip(lines, marked, strict=True)], True
    kept = [i for a, b in blocks_of(lengths) for i in range(a, b) if lengths[i] or not heeded] or [i for i, n in enumerate(lengths) if n]
    return "\n".join(lines[i][0] for i in kept if not lines[i][1])


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns but that of the html, and text."""
    others = [c for c in df.columns if c not in (html_col, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string())], names=[*others, "text"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.select(*others, F.col(html_col).cast("string")).mapInArrow(run, f"{schema}, text string" if others else "text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
